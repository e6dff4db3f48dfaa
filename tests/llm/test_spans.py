import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terrafold.llm import spans

D = "doc_id long, text string, doc long, digest string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], D)


def naive_pairs(texts, n):
    grams = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - n + 1):
            grams.setdefault(t[k : k + n], set()).add(i)
    return sorted({(a, b) for g in grams.values() for a in g for b in g if a < b})


def naive_shared(texts, n):
    grams = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - n + 1):
            grams.setdefault(t[k : k + n], set()).add(i)
    out = []
    for i, t in enumerate(texts):
        covered = set()
        for k in range(len(t or "") - n + 1):
            if len(grams[t[k : k + n]]) > 1:
                covered |= set(range(k, k + n))
        out.append(len(covered))
    return out


def corpus(seed, n, alphabet, pieces):
    r = random.Random(seed)

    def text(k):
        return "".join(r.choice(alphabet) for _ in range(k))

    shared = [text(k) for k in pieces]
    out = []
    for _ in range(n):
        parts = [text(r.randint(0, 120)) if r.random() < 0.6 else r.choice(shared) for _ in range(r.randint(0, 4))]
        out.append("".join(parts))
    return out


def check(spark, texts, n=80):
    df = frame(spark, texts)
    assert sorted((r.doc_a, r.doc_b) for r in spans.shared_pairs(df, min_span=n).collect()) == naive_pairs(texts, n)
    got = {r.doc_id: r.shared_chars for r in spans.shared_share(df, min_span=n).collect()}
    assert [got[i] for i in range(len(texts))] == naive_shared(texts, n)


def test_random_corpora(spark):
    check(spark, corpus(1, 120, "abcdefghijklmnopqrstuvwxyz ", [79, 80, 81, 95, 160, 300]))
    check(spark, corpus(2, 60, "ab", [79, 80, 90, 200]))  # much repeats by chance
    check(spark, corpus(3, 60, "añ漢😀 \n", [80, 83, 120]), 70)


def test_periodic_texts(spark):
    check(spark, ["a" * 79, "a" * 80, "a" * 5000, "ab" * 60, "b" + "ab" * 60, "abc" * 40 + "x", "abc" * 40, ("x" * 40 + "y" * 41) * 9, "y" * 41 + "x" * 40 + "y" * 40])


def test_one_occurrence_of_a_gram_decides(spark):
    r = random.Random(4)
    gram = "".join(r.choice("klmnop") for _ in range(64))
    a = "Q" * 5 + gram + "R" * 30 + gram + "abcdefghijklmnopqrst" + "S"
    b = "T" * 9 + gram + "abcdefghijklmnopqrst" + "U" * 9
    check(spark, [a, b, gram + "Z" * 20])


def test_dirty(spark):
    long = "word " * 40
    texts = [None, "", " ", long, long, long + "!", "short", long[:79], "\x00" * 90, "\x00" * 90 + "\n"]
    check(spark, texts)
    assert spans.shared_pairs(frame(spark, [])).count() == 0
    assert spans.shared_share(frame(spark, [])).count() == 0


def test_large_groups_go_through_blocks(spark):
    r = random.Random(9)
    shared = "".join(r.choice("abcdef") for _ in range(100))
    texts = ["".join(r.choice("ghijk") for _ in range(10)) + shared for _ in range(60)] + [shared] * 40
    df = frame(spark, texts)
    whole = sorted((x.doc_a, x.doc_b) for x in spans.shared_pairs(df).collect())
    assert whole == naive_pairs(texts, 80)
    classes = spans.text_classes(df)
    links = spans.shared_links(spans.unique_texts(df, classes), block=7)
    assert links.count() == 61 * 60 // 2
    assert sorted((x.doc_a, x.doc_b) for x in spans.class_pairs(classes, block=7).collect()) == [(a, b) for a in range(60, 100) for b in range(a + 1, 100)]


def test_a_passage_in_many_texts_makes_no_pairs_for_shares(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdef") for _ in range(90))
    texts = [f"{i:05d}" + passage + f"{i * 7:05d}" for i in range(3000)]
    rows = spans.shared_share(frame(spark, texts)).collect()
    assert len(rows) == 3000 and all(90 <= x.shared_chars <= 100 for x in rows)


def test_every_run_holds_a_chunk():
    r = random.Random(12)
    for alphabet in ("ab", "abcdefgh ", "xyzäöü漢字"):
        for n in (48, 66, 80, 120):
            run = "".join(r.choice(alphabet) for _ in range(n))
            found = []
            for _ in range(3):
                text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 90))) + run + "".join(r.choice(alphabet) for _ in range(r.randint(0, 90)))
                t, at = spans.Texts([text]), text.index(run)
                found.append({text[i:j] for i, j in zip(*t.chunks(n), strict=True) if at <= i and j <= at + n})
            assert set.intersection(*found)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab", max_size=200), max_size=8), st.integers(48, 100))
def test_any_texts(spark, texts, n):
    df = frame(spark, texts)
    assert sorted((r.doc_a, r.doc_b) for r in spans.shared_pairs(df, min_span=n).collect()) == naive_pairs(texts, n)


def test_runs_are_given_each_way(spark):
    r = random.Random(9)

    def letters(n):
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    texts, want = [], set()
    for k in range(150):
        passage = letters(150)
        at = r.randrange(5, 40)
        texts += ["#" + passage + "!", letters(at) + "+" + passage + "-" + letters(30) + "+" + passage + "-"]
        want |= {(2 * k, 2 * k + 1, 1, at + 1, 150), (2 * k, 2 * k + 1, 1, at + 183, 150)}
    docs = frame(spark, texts).selectExpr("doc_id AS doc", "text")
    assert {tuple(x) for x in spans.shared_runs(docs).collect()} == want
