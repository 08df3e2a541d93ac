import math
import random
from collections import Counter

from traceloom.llm.stuffing import page_counts, page_curves, plain_word, stuffed_pages, stuffed_share, suspects, vocabulary, words

NOUNS = [f"{a}{b}" for a in ("har", "lan", "mea", "orc", "gra", "cop", "whi", "gar", "ste", "vel") for b in ("bour", "tern", "dow", "hard", "nary", "per", "tle", "dener", "eple", "vet")]


def _prose(rnd, n):
    out = []
    while len(out) < n:
        out += ["the", rnd.choice(NOUNS), "of", "the", rnd.choice(NOUNS), "was", rnd.choice(NOUNS), "and", rnd.choice(NOUNS) + "."]
    return out


def _pages(seed=1):
    rnd = random.Random(seed)
    pages = [(i, " ".join(_prose(rnd, rnd.randint(80, 250))), "en") for i in range(200)]
    kw = " ".join(rnd.choice(["copper pans,", "wax candles!", "iron stoves"]) for _ in range(90))
    links = " ".join(f"http://shop{k}.example/item/{k} {rnd.choice(NOUNS)}" for k in range(70))
    tags = "; ".join(f"tin kettles; new; size-{k}; SKU{k * 77}" for k in range(50))
    places = " | ".join(f"gartensamen Ort{k}stadt" for k in range(80))
    spam = [(1000, kw, "en"), (1001, links, "EN"), (1002, tags, None), (1003, places, "de"), (1004, " ".join(_prose(rnd, 60)) + " " + kw, "en"), (1005, "#sale #pans " * 60, "en")]
    prices = "\n".join(f"{rnd.choice(['tin kettles', 'felt hats', 'wax candles'])} ..... {k} s. {k % 12} d." for k in range(60))
    times = "\n".join(f"Ort{k}, Dorf{k}, dep. {k % 12}.{k}, arr. {k % 11}.{k}" for k in range(60))
    few = " ".join(_prose(rnd, 120)) + " copper pans copper pans copper pans " + " ".join(_prose(rnd, 120)) + " http://a.example/x"
    fine = [(2000, prices, "en"), (2001, times, "en"), (2002, few, "en"), (2003, None, "en"), (2004, "", None), (2005, " \n\t ", "en"), (2006, " ".join(f"Name{k} Other{k}," for k in range(100)), "en"), (None, kw, "en")]
    return pages, spam, fine


def test_found(spark):
    pages, spam, fine = _pages()
    rows = [(*r, "x") for r in [*pages, *spam, *fine, spam[0]]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, word string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == [i for i, _, _ in spam]
    assert stuffed_pages(df.limit(0)).count() == 0


def test_curve_is_the_least_squares_line(spark):
    text = " ".join(w for k, w in enumerate(NOUNS[:9]) for _ in range((3, 7, 1, 1, 2, 2, 2, 9, 1)[k]))
    df = spark.createDataFrame([(1, text, "en"), (2, "one", "en"), (3, "a a a a", "en")], "doc_id bigint, text string, lang string")
    c = page_counts(df)
    got = {r.key: r for r in page_curves(c, vocabulary(c)).collect()}
    freq = sorted(Counter(text.split()).values(), reverse=True)
    ranks = [sum(1 for g in freq if g > f) + (sum(1 for g in freq if g == f) + 1) / 2 for f in freq]
    x, y = [math.log(r) for r in ranks], [math.log(f) for f in freq]
    mx, my = sum(x) / len(x), sum(y) / len(y)
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    rms = math.sqrt(sum((b - my - slope * (a - mx)) ** 2 for a, b in zip(x, y)) / len(x))
    assert abs(got[1].slope - slope) < 1e-9 and abs(got[1].residual - rms) < 1e-6 and got[1].n == len(text.split())
    assert got[2].slope == 0 and got[3].types == 1


def test_words_agree_with_plain_word(spark):
    text = "Äpfel, Schleuſen! don't boots\nexam-\nple 12s"
    got = spark.createDataFrame([(text,)], "t string").select(words_col()).first()[0]
    assert got == [plain_word(w) for w in "Äpfel, Schleuſen! don't boots example 12s".split()]


def words_col():
    from pyspark.sql import functions as F

    return words(F.col("t")).alias("w")


def test_share():
    assert stuffed_share(None, set()) == 0 and stuffed_share("... —", {"a"}) == 0
    assert stuffed_share("pans pans pans", {"pan"}) == 1.0
    assert stuffed_share("x " * 100 + "http://a.example", set()) < 0.1


def test_small_groups_are_all_suspects(spark):
    df = spark.createDataFrame([(1, "a b c", "en")], "doc_id bigint, text string, lang string")
    c = page_counts(df)
    assert suspects(page_curves(c, vocabulary(c))).count() == 1


def test_many_copies_are_not_their_own_standard(spark):
    pages, spam, _ = _pages()
    copies = [(3000 + i, spam[0][1], "en") for i in range(120)]
    df = spark.createDataFrame([*pages, *copies], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == [i for i, _, _ in copies]


def _varied(rnd):
    common = ["the"] * 16 + ["and", "was"] * 8 + ["of"] * 6
    rare = [n + end for n in NOUNS for end in ("", "ing", "ed", "er")]
    return [(i, " ".join(rnd.choice(common) if rnd.random() < 0.25 else rnd.choice(rare) for _ in range(rnd.randint(80, 250))), "en") for i in range(200)]


def test_many_pages_of_one_keyword_list(spark):
    rnd = random.Random(5)
    pages = _varied(rnd)
    goods = ["copper pans,", "wax candles!", "iron stoves", "felt hats", "tin kettles;"]
    shared = [(3000 + i, " ".join(rnd.choice(goods) for _ in range(rnd.randint(70, 110))), "en") for i in range(250)]
    df = spark.createDataFrame([*pages, *shared], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == [i for i, _, _ in shared]


def test_endings_and_tags_the_code_does_not_name(spark):
    pages, _, fine = _pages()
    rnd = random.Random(8)
    spam = [
        " ".join(f"gartenshop{k}.de" for k in range(80)),
        " ".join(f"tools{k}.biz Katalog{k}" for k in range(80)),
        " ".join(f"tag: kessel{k}; art-nr N{k}99;" for k in range(60)),
        " ".join(f"{rnd.choice(NOUNS)}{rnd.choice(NOUNS)}.{rnd.choice(['at', 'shop', 'example'])}/{rnd.choice(NOUNS)}" for _ in range(90)),
        " ".join(f"@{rnd.choice(NOUNS)} {rnd.choice(NOUNS)}" for _ in range(90)),
        " ".join(f"{rnd.choice(NOUNS)} REF{k * 137 + 1000}," for k in range(90)),
    ]
    rows = [*pages, *fine, *((4000 + i, t, "en") for i, t in enumerate(spam))]
    one = " ".join(_prose(rnd, 150)) + " gartenshop.de tools.biz/x www.felt-hats.at " + " ".join(_prose(rnd, 100))
    df = spark.createDataFrame([*rows, (5000, one, "en")], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == [4000 + i for i in range(len(spam))]


def test_a_language_that_is_mostly_link_lists(spark):
    rnd = random.Random(3)
    pages = _varied(rnd)
    lists = [(3000 + i, " ".join(f"{rnd.choice(NOUNS)}{k}.de/{rnd.choice(NOUNS)}" for k in range(rnd.randint(70, 120))), "en") for i in range(300)]
    df = spark.createDataFrame([*pages, *lists], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in stuffed_pages(df).collect()) == [i for i, _, _ in lists]
