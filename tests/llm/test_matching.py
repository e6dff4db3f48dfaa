import datetime as dt
import random

import numpy as np
import pyarrow as pa

from terrafold.llm import matching

W = "place_id long, name string, category string, city string, country string, address string, website string, lat double, lon double, rating double, fetched_at timestamp_ntz, id long, key string"
P = "osm_id long, lat double, lon double, category string, name string, extract_name string, edited_at timestamp_ntz, loaded_at timestamp_ntz, town string, place long"
NOW = dt.datetime(2024, 1, 1)


def web(i, name, lat, lon, city="Town", cat="shops"):
    return (i, name, cat, city, "X", None, None, lat, lon, None, NOW, 1, "k")


def poi(i, name, lat, lon, cat="shop:books"):
    return (i, lat, lon, cat, name, "e", NOW, NOW, "t", 2)


def names(seed, n):
    r = random.Random(seed)
    syl = ["ka", "ro", "mi", "tu", "bel", "zan", "pod", "gir", "nus", "hex", "lim", "sor"]
    kinds = ["Books", "Café", "Hotel", "Market"]
    return ["".join(r.choice(syl) for _ in range(3)).capitalize() + " " + "".join(r.choice(syl) for _ in range(2)).capitalize() + " " + r.choice(kinds) for _ in range(n)]


def town(seed, n=400):
    r = random.Random(seed)
    out = []
    for i, name in enumerate(names(seed, n)):
        out.append((1000 + i, name, 43.0 + r.uniform(0, 0.05), -79.99 + r.uniform(0, 0.05)))
    return out, r


def noisy(name, r):
    k = r.randrange(4)
    at = r.randrange(1, len(name) - 2)
    if k == 0:
        return name[:at] + name[at + 1] + name[at] + name[at + 2 :]
    if k == 1:
        return "The " + name.upper() + ", since 1931"
    if k == 2:
        return name.replace(" ", "")
    return name + "'s"


def test_matches_in_a_made_town(spark):
    real, r = town(1)
    pois = [poi(i, n, la, lo) for i, n, la, lo in real]
    places = [web(i - 1000, noisy(n, r), la + r.uniform(-4e-4, 4e-4), lo + r.uniform(-4e-4, 4e-4)) for i, n, la, lo in real[:200]]
    strangers = [web(5000 + k, n, 43.0 + r.uniform(0, 0.05), -79.99 + r.uniform(0, 0.05)) for k, n in enumerate(names(77, 150))]
    unplaced = [web(i - 1000, n, None, None) for i, n, _, _ in real[350:380]]
    df = matching.match_places(spark.createDataFrame(places + strangers + unplaced, W), spark.createDataFrame(pois, P)).collect()
    got = {(x.place_id, x.poi_id) for x in df}
    want = {(i - 1000, i) for i, *_ in real[:200] + real[350:380]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(want)
    assert all(0.5 <= x.confidence <= 1 for x in df) and {x.route for x in df} == {"near", "town"}


def test_dirty_rows(spark):
    real, r = town(3, 60)
    pois = [poi(i, n, la, lo) for i, n, la, lo in real]
    pois += [poi(None, "x", 1.0, 1.0), poi(1, None, 1.0, 1.0), poi(2, "  ", 43.0, -79.98), poi(3, "q" * 5000, 43.0, -79.98), poi(real[0][0], None, None, None), poi(4, "ß", 99.0, 500.0), poi(5, "Only", None, None)]
    places = [web(i - 1000, n, la, lo) for i, n, la, lo in real] * 2 + [web(9, None, None, None, None), web(None, "x", 1.0, 1.0), web(10, "", float("nan"), 0.0), web(11, "q" * 5000, 0.0, 0.0, None, None), web(12, "!!!", 43.0, -79.98)]
    df = matching.match_places(spark.createDataFrame(places, W), spark.createDataFrame(pois, P)).collect()
    got = [(x.place_id, x.poi_id) for x in df]
    assert len(got) == len(set(got)) and len(set(got) & {(i - 1000, i) for i, *_ in real}) >= 57


def test_empty(spark):
    w, p = spark.createDataFrame([web(1, "A b", 1.0, 1.0)], W), spark.createDataFrame([poi(1, "A b", 1.0, 1.0)], P)
    for a, b in ((w.limit(0), p), (w, p.limit(0)), (w.limit(0), p.limit(0))):
        assert matching.match_places(a, b).collect() == []


def test_copies_are_matched_through_one(spark):
    real, r = town(8, 80)
    pois = [poi(i, n, la, lo) for i, n, la, lo in real] + [poi(9000 + k, *real[0][1:]) for k in range(50)]
    places = [web(i - 1000, n, la, lo) for i, n, la, lo in real] + [web(7000 + k, *real[0][1:]) for k in range(40)]
    got = {(x.place_id, x.poi_id) for x in matching.match_places(spark.createDataFrame(places, W), spark.createDataFrame(pois, P)).collect()}
    a, b = {0, *range(7000, 7040)}, {1000, *range(9000, 9050)}
    assert {(x, y) for x in a for y in b} <= got and len(got) <= 41 * 51 + 90


def test_town_route_meets_reordered_and_mistyped_names(spark):
    real, r = town(11, 300)
    pois = [poi(i, n, la, lo) for i, n, la, lo in real]
    places = [web(i - 1000, n, la, lo) for i, n, la, lo in real[:150]]
    turned = []
    for i, n, _, _ in real[200:240]:
        a, b, kind = n.split()
        turned.append(web(i - 1000, f"{kind} {b[1]}{b[0]}{b[2:]} {a}", None, None))
    df = matching.match_places(spark.createDataFrame(places + turned, W), spark.createDataFrame(pois, P)).where("route = 'town'").collect()
    got, want = {(x.place_id, x.poi_id) for x in df}, {(i - 1000, i) for i, *_ in real[200:240]}
    assert len(got & want) >= 0.75 * len(want) and len(got - want) <= 0.25 * len(want)


def test_places_without_a_city(spark):
    real, r = town(21, 200)
    real = [(i, n, la, lo + 60) for i, n, la, lo in real]
    pois = [poi(i, n, la, lo) for i, n, la, lo in real]
    places = [web(i - 1000, n, la, lo) for i, n, la, lo in real[:100]]
    exchanged = [web(i - 1000, n, lo, la, None) for i, n, la, lo in real[120:140]]
    unplaced = [web(i - 1000, n, None, None, " ") for i, n, _, _ in real[150:160]] + [web(i - 1000, f"{n} @ Town", None, None, None) for i, n, _, _ in real[160:170]]
    df = matching.match_places(spark.createDataFrame(places + exchanged + unplaced, W), spark.createDataFrame(pois, P)).collect()
    got = {(x.place_id, x.poi_id): x.route for x in df}
    for part, route in ((real[120:140], "near"), (real[150:160], "town"), (real[160:170], "town")):
        assert sum(got.get((i - 1000, i)) == route for i, *_ in part) >= 0.8 * len(part)


def test_near_route_meets_short_and_reordered_names(spark):
    real, r = town(31, 150)
    odd = [(1, "Trivita Gym", "Gym Trivtia"), (2, "Pelgas", "Plsas"), (3, "Quorvex Inn", "Inn Quovrex"), (4, "Dunfob", "Dnufob")]
    at = [(43.2 + k / 100, -79.5) for k, _, _ in odd]
    pois = [poi(i, n, la, lo) for i, n, la, lo in real] + [poi(5000 + k, n, *p) for (k, n, _), p in zip(odd, at, strict=True)]
    places = [web(i - 1000, n, la, lo) for i, n, la, lo in real[:100]] + [web(5000 + k, n, *p, None) for (k, _, n), p in zip(odd, at, strict=True)]
    got = {(x.place_id, x.poi_id) for x in matching.match_places(spark.createDataFrame(places, W), spark.createDataFrame(pois, P), threshold=0.0).collect()}
    assert {(5000 + k, 5000 + k) for k, _, _ in odd} <= got


def frame_of(pool):
    terms = [matching.name_terms(matching.name_words(n)) for n in pool]
    n = len(pool)
    return pa.table({"terms": pa.array(terms, pa.list_(pa.int32())), "id": pa.array(range(n), pa.int64())}), terms


def weights_of(terms):
    w = object.__new__(matching.Weights)
    df = np.zeros(matching.BUCKETS)
    for t in terms:
        df[np.array(t) // (matching.MOST_TF + 1)] += 1
    w.idf = np.where(df > 0, np.log1p((len(terms) - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
    w.mean_length = float(np.mean([sum(x % (matching.MOST_TF + 1) for x in t) for t in terms]))
    return w


def test_postings_lose_none_of_the_best_and_scores_are_bm25(monkeypatch):
    r = random.Random(5)
    pool = names(6, 120) + ["Bobobobobo Bobo", "Aa", "x"]
    table, terms = frame_of(pool)
    w = weights_of(terms)
    shards = np.array([r.randrange(3) for _ in pool])
    index = matching.Index(table, shards, w, 3)
    bucket = np.concatenate([np.array(t) // (matching.MOST_TF + 1) for t in terms])
    query = np.repeat(np.arange(len(pool)), [len(t) for t in terms])
    lots = list(index.candidates(shards, query, bucket))
    monkeypatch.setattr(matching, "LOT", 300)
    small = list(index.candidates(shards, query, bucket))
    assert len(small) > 20 and {(a, b) for q, d in lots for a, b in zip(q, d)} == {(a, b) for q, d in small for a, b in zip(q, d)}
    q, d = (np.concatenate(c) for c in zip(*lots))
    score, of_query, of_doc = index.scores(q, d, query, bucket, len(pool))
    got = {(a, b): s for a, b, s in zip(q.tolist(), d.tolist(), score.tolist())}
    for a in range(len(pool)):
        full = []
        for b in range(len(pool)):
            parts = {}
            length = sum(x % 4 for x in terms[b])
            for x in terms[b]:
                g, tf = divmod(x, 4)
                parts[g] = float(w.idf[g]) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / w.mean_length))
            shared = sum(v for g, v in parts.items() if g in {x // 4 for x in terms[a]})
            if shards[a] == shards[b] and shared >= matching.FLOOR * sum(parts.values()):
                full.append((shared, b))
            if (a, b) in got:
                assert shards[a] == shards[b] and abs(got[a, b] - shared) < 1e-4
        full.sort(reverse=True)
        for k, (shared, b) in enumerate(full):
            if k < matching.TOP or shared >= matching.MARGIN * full[0][0]:
                assert (a, b) in got
    assert all(abs(x - 1) < 1e-6 for x, a, b in zip(of_doc, q, d) if a == b) and all(abs(x - 1) < 1e-6 for x, a, b in zip(of_query, q, d) if a == b)


def test_split_shards_find_the_same(spark):
    real, r = town(41, 300)
    pois = [poi(i, n, la, lo) for i, n, la, lo in real]
    places = [web(i - 1000, noisy(n, r), la, lo) for i, n, la, lo in real[:150]] + [web(i - 1000, n, None, None) for i, n, _, _ in real[200:240]]
    w, p = spark.createDataFrame(places, W), spark.createDataFrame(pois, P)
    whole = {(x.place_id, x.poi_id) for x in matching.match_places(w, p).collect()}
    retrieved, block = matching.retrieved, matching.BLOCK_ROWS
    try:
        matching.retrieved = lambda q, d, weights, floor=matching.FLOOR: retrieved(q, d, weights, floor, shard_rows=7)
        matching.BLOCK_ROWS = 11
        assert {(x.place_id, x.poi_id) for x in matching.match_places(w, p).collect()} == whole and len(whole) > 150
    finally:
        matching.retrieved, matching.BLOCK_ROWS = retrieved, block


def test_a_website_spells_the_name(spark):
    real, r = town(51, 200)
    pois = [poi(i, n, la, lo) for i, n, la, lo in real]
    places = [web(i - 1000, n, la, lo) for i, n, la, lo in real[:100]]
    cut = [(i, "".join(n.split()).lower().replace("é", "e"), la, lo) for i, n, la, lo in real[150:180]]
    places += [(i - 1000, "Our Shop", "shops", "Town", "X", None, f"https://www.{h}77.example/menu", la, lo, None, NOW, 1, "k") for i, h, la, lo in cut]
    got = {(x.place_id, x.poi_id) for x in matching.match_places(spark.createDataFrame(places, W), spark.createDataFrame(pois, P)).collect()}
    assert sum((i - 1000, i) in got for i, *_ in cut) >= 28


def test_words():
    assert matching.name_words("The Rusty   Kettle (Oldtown)", "Oldtown") == ["the", "rusty", "kettle"]
    assert matching.name_words("R_kbund CAFÉ's") == ["r", "kbund", "cafe", "s"] and matching.name_words(None) == [] and matching.name_words("The") == ["the"]
    assert matching.name_words("L'Œuf Doré") == ["l", "oeuf", "dore"] and matching.name_words("Oldtown", "Oldtown") == ["oldtown"]
    assert matching.host_word("https://www.lufdore.example/menu") == "lufdore" and matching.host_word(" HTTP://a.b-long.co:80") == "long"
    assert matching.host_word(None) == matching.host_word("") == matching.host_word("///") == ""
    assert len(set(matching.name_terms(["rusty", "kettle"])) ^ set(matching.name_terms(["kettle", "rusty"]))) <= 4


def test_logistic():
    r = np.random.default_rng(1)
    x = np.r_[r.normal(1, 1, (500, 2)), r.normal(-1, 1, (500, 2))]
    w = matching.fit_logistic(x, np.r_[np.ones(500), np.zeros(500)])
    assert ((x @ w[1:] + w[0] > 0) == np.r_[np.ones(500), np.zeros(500)]).mean() > 0.9
