"""What holds for every operator on documents: numbers beside nulls, and columns of any name."""

import random

import pytest
from pyspark.sql import functions as F

from accordant.llm import bpe, decontaminate, exact_dedup, hard_negatives, html_text, jaccard_join, language_id, near_dedup, secrets, toxicity
from accordant.llm.common import table

BIG = [(1 << 60) + 1, (1 << 60) + 3]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="module")
def big(spark):
    """Large numbers beside a null, in one batch; a nullable number of the user's; names that the operators make."""
    names = "n_words long, marks string, item_ids string, found string, doc string, place long, label string, digest string, lang_pred string, rejected string, score string, n_tokens long, ids string, keep_id long, node long, row long, key string"
    rows = [(BIG[0], f"{WORDS} one", BIG[1], *[None] * 17), (None, f"{WORDS} two of a kind", None, *[None] * 17), (BIG[1], "a short text without any window", BIG[0], *[None] * 17)]
    return spark.createDataFrame(rows, f"doc_id long, text string, mine long, {names}").coalesce(1)


@pytest.fixture(scope="module")
def models():
    return {
        "lang": language_id.Centroids([WORDS, "le chat et le chien"] * 3, ["en", "fr"] * 3),
        "bag": toxicity.Bag([WORDS, "bad bad words"], [0, 1]),
        "chains": secrets.Chains(["a8Kz0pQx71LmW3vB9dTr"] * 3, ["ordinary_identifier_name"] * 3),
    }


def test_numbers_beside_nulls(spark, big, models):
    items = spark.createDataFrame([("i", WORDS)], "item_id string, text string")
    pages = big.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    got = {
        "encode": bpe.encode_documents(big), "digests": bpe.token_digests(big), "scan": secrets.scan(big, models["chains"]), "toxicity": toxicity.toxicity(big, models["bag"]),
        "matches": decontaminate.matches(big, items), "near": near_dedup.near_classes(big), "languages": language_id.languages(big.select("doc_id", "text"), models["lang"]),
        "pages": html_text.extract(pages).withColumnRenamed("page_id", "doc_id"), "join": jaccard_join.jaccard_components(big), "exact": exact_dedup.exact_copies(big),
    }
    for name, df in got.items():
        assert sorted(r.doc_id for r in df.collect() if r.doc_id is not None) == BIG, name
        assert df.filter("doc_id is null").count() == 1, name


def test_stages_keep_columns_of_any_name(spark, big):
    items = spark.createDataFrame([("i", WORDS)], "item_id string, text string")
    left = decontaminate.drop_contaminated(big, items)
    assert left.columns == big.columns and [(r.doc_id, r.mine) for r in left.collect()] == [(BIG[1], BIG[0])]
    for stage in (exact_dedup.drop_exact_copies, near_dedup.drop_near_copies):
        kept = stage(big)
        assert kept.columns == big.columns and sorted(str(r.mine) for r in kept.collect()) == sorted(map(str, [*BIG, None]))
    known = language_id.keep_known(big.withColumn("lang", F.lit("en")))
    assert known.columns == [*big.columns, "lang"] and {r.mine for r in known.collect()} <= {*BIG, None}


def test_blocks_of_items_meet(spark, big, monkeypatch):
    items = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate([WORDS, WORDS.replace("alpha", "omega"), "a short text without any window", "nothing of it", None])], "item_id string, text string")
    want = sorted(map(str, decontaminate.matches(big, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)
    assert len(list(decontaminate.blocks(items))) > 2
    assert sorted(map(str, decontaminate.matches(big, items).collect())) == want


def test_long_texts_count_every_gram_once(monkeypatch):
    text = "".join(chr(97 + k * k % 23) for k in range(200))
    whole = language_id.Centroids.counts([text])
    monkeypatch.setattr(language_id, "STEP_CHARS", 7)
    assert (language_id.Centroids.counts([text]) == whole).all()


def test_secrets_by_the_models_on_labelled_strings(spark, sf):
    """Recall and false alarms of the models alone: random runs, identifiers of other documents' words, and identifiers of a language that the training lacks."""
    chains = secrets.fit(table(spark, sf.replace("0.001", "0.01"), "documents"))
    draw = random.Random(77)
    alphabet = secrets.ALPHABET[:64]
    keys = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(24, 64))) for _ in range(150)]
    parts = "user account service request handler manager default config parser value index buffer stream session update remote local cache query result table column number string object factory builder adapter provider context element message channel".split()
    names = [draw.choice(["_", "-", "/"]).join(draw.choice(parts) for _ in range(draw.randrange(3, 7))) for _ in range(150)]
    names = [n for n in names if len(n) >= 20]
    words = sorted({w for r in table(spark, sf.replace("0.001", "0.1"), "documents").filter("doc_id > 5000").select("text").limit(300).collect() for w in secrets.WORD.findall(r.text or "") if len(w) < 15})
    own = ["_".join(draw.choice(words) for _ in range(4)) for _ in range(300)]
    alarms_own = sum(bool(secrets.spans(f"see {n} there", chains)[1]) for n in own)
    found = [bool(secrets.spans(f"see {k} there", chains)[1]) for k in keys]
    alarms = [bool(secrets.spans(f"see {n} there", chains)[1]) for n in names]
    assert sum(found) >= 0.95 * len(found) and alarms_own <= 0.02 * len(own) and sum(alarms) <= 0.15 * len(alarms), (sum(found), alarms_own, sum(alarms), len(names))
    print("keys", sum(found), "of 150; own words", alarms_own, "of 300; other language", sum(alarms), "of", len(names))
    # a run beside the part of it that a pattern takes
    mixed = "Zq8Xw2Lk9PvB7nMc4RtYh1/0123456789abcdef0/QwErTy9ZzKpLm2"
    base, every = secrets.spans(mixed, chains)
    assert [s[2] for s in base] == ["hex"] and (0, len(mixed), "markov") in every
    assert all(s[2] != "markov" for s in secrets.spans("password = a8Kz0pQx71LmW3vB9dTr", chains)[1])
