import random

from terrafold.llm import mixing

D = "doc_id long, text string, source string, lang string, n_tokens int, repeats string"
T = "source string, target_share double, max_repeats int"


def docs(spark, n=1500, seed=1):
    r = random.Random(seed)
    names = [" Alpha", "alpha", "BETA ", "gamma", None, "", "other"]
    weights = [30, 20, 20, 4, 5, 2, 10]
    rows = []
    for i in range(n):
        s = r.choices(names, weights)[0]
        text = None if r.random() < 0.03 else " ".join(r.choice(["harbour", "station", "lamp", "bridge", "library"]) for _ in range(r.randint(0, 40)))
        rows.append((i, text, s, r.choice(["en", "EN", "eng", "de-AT", "fr", None, "xx1"]), 5, "x"))
    return spark.createDataFrame(rows, D)


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("alpha", 0.4, 1), ("Beta", 0.35, 2), ("gamma", 0.2, 4), ("absent", 0.05, 9)], T)
    df = docs(spark)
    chosen = mixing.mixture(df, targets, stratum=100)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    caps = {"alpha": 1, "beta": 2, "gamma": 4}
    assert all(1 <= r.repeats <= caps[r.source] for r in rows)
    shares = {r.source: r for r in mixing.reached_shares(chosen, targets).collect()}
    assert shares["absent"].n_records == 0 and shares["absent"].reached_share == 0.0
    for s, want in (("alpha", 0.4), ("beta", 0.35), ("gamma", 0.2)):
        assert abs(shares[s].reached_share - want / 0.95) < 0.01
    again = mixing.mixture(df, targets, stratum=100).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_marginals_are_raked():
    cells = [("a", "en", "-", 1000.0), ("a", "de", "-", 1000.0), ("b", "en", "-", 3000.0), ("b", "de", "-", 500.0)]
    p = mixing.rake(cells, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 10}, {1: {"en": 0.7, "de": 0.3}, 2: {"-": 1.0}})
    tokens = {c[:3]: c[3] * p.weights[c[:3]] for c in cells}
    whole = sum(tokens.values())
    assert abs(sum(v for k, v in tokens.items() if k[0] == "a") / whole - 0.5) < 1e-6
    assert abs(sum(v for k, v in tokens.items() if k[1] == "en") / whole - 0.7) < 1e-3
    assert all(w <= 10 for w in p.weights.values())


def test_caps_bind():
    p = mixing.rake([("a", "en", "-", 100.0), ("b", "en", "-", 1e6)], {"a": 0.5, "b": 0.5}, {"a": 3, "b": 1})
    assert abs(p.weights["a", "en", "-"] - 3) < 1e-6 and abs(p.total - 600) < 1e-6 and abs(p.weights["b", "en", "-"] - 3e-4) < 1e-9


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("alpha", 1.0, 1)], T)
    assert mixing.mixture(docs(spark).limit(0), targets).count() == 0
    assert mixing.mixture(docs(spark), targets.limit(0)).count() == 0
    assert mixing.rake([], {}, {}).total == 0.0 and mixing.rake([("a", "en", "-", 5.0)], {"a": 1.0}, {"a": 0}).weights == {}


def test_languages(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in ("en", "EN-gb", "de_AT", "ger", " jp ", "es-419", None, "", "English", "x")], "l string")
    got = [r.c for r in rows.select(mixing.language_code(F.col("l")).alias("c")).collect()]
    assert got == ["en", "en", "de", "de", "ja", "es", "und", "und", "und", "und"]


def test_topics_are_the_rarest_of_frequent_words(spark):
    targets = spark.createDataFrame([("alpha", 1.0, 1)], T)
    texts = ["common words here"] * 4 + ["common harbour"] * 3 + ["common harbour station"] * 2 + ["nothing"] * 21 + [None, "", "x"]
    rows = spark.createDataFrame([(i, t, "alpha", "en", 0, "") for i, t in enumerate(texts)], D)
    got = {r.doc_id: r.topic for r in mixing.sized_records(rows, targets, topics=2).collect()}
    assert got[0] == "common" and got[4] == got[7] == "harbour" and got[9] == "-" and got[32] == "-" and 30 not in got and 31 not in got
    given = {r.doc_id: r.topic for r in mixing.sized_records(rows.selectExpr("*", "nullif(doc_id % 3, 2) AS topic"), targets).collect()}
    assert given[0] == "0" and given[1] == "1" and given[2] == "-"
    assert mixing.topic_words("Die Brücken und 東京都です") == {"brücken", "東京", "京都", "都で", "です"} and mixing.topic_words(None) == set()


def test_sketches_keep_what_is_frequent():
    r = random.Random(3)
    counts, exact = {}, {}
    for k in range(30_000):
        w = "often" if r.random() < 0.05 else f"w{r.randrange(20_000)}"
        counts[w] = counts.get(w, 0) + 1
        exact[w] = exact.get(w, 0) + 1
        if len(counts) > 400:
            counts = mixing.pruned(counts, 50)
    assert 0 <= exact["often"] - counts["often"] <= 30_000 / 50
