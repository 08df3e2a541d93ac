import random

import numpy as np
import pytest

from traceloom.llm.leaks import WINDOW, Patterns, codes, follow, leaks, letters, longest, near, page_leaks, passage, reading_order, scan

WORDS = "harbour lantern meadow orchard granary copper whistle gardener steeple velvet anchor thimble pasture candle saddle mortar ribbon hammer cellar tunnel blossom cabbage drummer falcon glacier hermit ivory jacket kettle lobster magnet needle oyster parcel quiver rocket signal turret urchin violet wagon yonder zephyr".split()


def _text(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice(WORDS) + rnd.choice(["", "s", "ed", "ing"]) for _ in range(n)]


def _pat(*texts):
    return Patterns([passage(i, t) for i, t in enumerate(texts)])


def test_scan_finds_every_window():
    texts = [" ".join(_text(k, 60)) for k in range(5)]
    pat = _pat(*texts)
    page = codes(" ".join(_text(9, 50)) + texts[2] + "\x00" + texts[4] + " ".join(_text(8, 3000)))
    start, slot = scan(page, pat)
    names = [pat.text[i : i + WINDOW].tobytes() for i in pat.place]
    known = set(names)
    want = {(i, w) for i in range(len(page) - WINDOW + 1) if (w := page[i : i + WINDOW].tobytes()) in known}
    assert want and {(int(a), names[b]) for a, b in zip(start, slot)} == want


def _found(page, *passages):
    return {(p, i): n for p, i, n in page_leaks([page], _pat(*passages))}


def test_whole_part_misread_and_set_between():
    words = _text(1, 60)
    p = " ".join(words)
    before, after = " ".join(_text(50, 80)), " ".join(_text(51, 80))
    assert _found(f"{before} {p.upper()} {after}", p)[0, 0] == 60
    assert _found(f"{before}\n{'-; '.join(words[10:34])}\n{after}", p)[0, 0] == 24
    assert not _found(f"{before} {' '.join(words[10:28])} {after}", p)  # a shorter quotation
    shuffled = words[:]
    random.Random(3).shuffle(shuffled)
    assert not _found(f"{before} {' '.join(shuffled)} {after}", p)
    swapped = words[30:45] + words[15:30] + words[:15] + words[45:]
    assert not _found(f"{before} {' '.join(swapped)} {after}", p)
    noisy = [w[:2] + "x" + w[3:] if k % 5 == 2 else w for k, w in enumerate(words)]
    assert _found(f"{before} {' '.join(noisy)} {after}", p)[0, 0] >= 55
    broken = " ".join(words[:20]) + " " + words[20][:3] + "-\nLOST near here, a purse of brown leather; reward.\n" + words[20][3:] + " " + " ".join(words[21:40])
    assert _found(f"{before} {broken} {after}", p)[0, 0] >= 38


def test_reading_order():
    boxes = [(0, 0, 90, 9), (100, 0, 190, 9), (0, 10, 90, 19), (100, 10, 190, 19)]
    assert reading_order("a\nc\nb\nd", 2, boxes).split() == list("abcd")
    assert reading_order("a  c\nb\td\ne | f", 2, [(0, 0, 190, 9), (0, 10, 190, 19), (0, 20, 190, 29)]).split() == list("abecdf")
    assert reading_order("a\nb", 1, boxes) == "a\nb" and reading_order("a\nb", None, None) == "a\nb" and reading_order("a\nb", 2, boxes) == "a\nb"


def test_small_parts():
    assert letters("Größe, ſo! ﬂow 3½") == "grosseso" + "flow3" + "12"
    assert near("abc", "abd", 1) and near("abcd", "abd", 1) and not near("abc", "xyz", 2)
    assert longest([0, 0, 1, 0, 2, 2, 2, 0]) == 4 and longest([]) == 0
    assert follow("abcdef", 0, "abc", [(0, 3)], frozenset()) == [0]
    assert len(codes("\x00a\x00")) == 3 and passage(1, " ... ") is None
    assert len(scan(np.zeros(0, np.uint32), _pat("a b c"))[0]) == 0


def test_frame(spark):
    p = " ".join(_text(1, 40))
    long = " ".join(_text(77, 400_000))
    pages = [(1, p, 1, None, "k"), (2, None, 1, None, "k"), (3, "", 2, None, "k"), (None, p, 1, None, "k"), (1, p, 1, None, "k"), (5, long[:2_500_000] + " " + p + " " + long[2_500_000:], None, None, "k"),
             (6, "\n".join(x for pair in zip(p.split()[:20], p.split()[20:]) for x in pair), 2, [r for k in range(20) for r in [(0, k * 10, 90, k * 10 + 9), (100, k * 10, 190, k * 10 + 9)]], "k")]
    df = spark.createDataFrame(pages, "doc_id bigint, text string, n_columns int, line_boxes array<struct<x0: int, y0: int, x1: int, y1: int>>, key string")
    items = spark.createDataFrame([(10, p), (11, None), (None, p), (12, "only four words here"), (10, p)], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id): r.n_words for r in leaks(df, items).collect()}
    assert got == {(1, 10): 40, (5, 10): 40, (6, 10): 40}
    assert leaks(df.limit(0), items).count() == 0 and leaks(df, items.limit(0)).count() == 0


def _made(seed, n, alphabet, blanks=True):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(3, 8)))) if blanks else rnd.choice(alphabet) for _ in range(n)]


SCRIPTS = {
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщыэюя", " "),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψωάέή", " "),
    "arabic": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", " "),
    "hebrew": ("אבגדהוזחטיכלמנסעפצקרשת", " "),
    "hindi": ("कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", " "),
    "korean": ("가나다라마바사아자차카타파하고노도로모", " "),
    "chinese": ("".join(chr(0x4E00 + 37 * k) for k in range(400)), ""),
    "japanese": ("あいうえおかきくけこさしすせそたちつてとなにぬねのカキクケコ東京大学日本国会議員", ""),
    "thai": ("กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวศษสหอฮ", ""),
}


@pytest.mark.parametrize("script", list(SCRIPTS))
def test_passages_of_any_script(script):
    alphabet, blank = SCRIPTS[script]
    spaced = bool(blank)
    unit = 1 if spaced or script != "thai" else 4  # Thai words are four letters
    words = _made(1, 60 * unit, alphabet, spaced)
    other = [_made(s, 80 * unit, alphabet, spaced) for s in (2, 3)]
    p = blank.join(words)
    before, after = (blank.join(o) for o in other)
    assert _found(f"{before}{blank}{p}{blank}{after}", p)[0, 0] == 60
    cut = blank.join(words[12 * unit : 42 * unit])
    assert _found(f"{before}\n{cut.upper()}。{blank}{after}", p)[0, 0] >= 29
    assert not _found(f"{before}{blank}{blank.join(words[10 * unit : 26 * unit])}{blank}{after}", p)
    assert not _found(f"{before}{blank}{blank.join(reversed(words))}{blank}{after}", p)
    wrong = [(w[:1] + alphabet[5] + w[2:] if len(w) > 1 else alphabet[5]) if k % (6 * unit) == 3 else w for k, w in enumerate(words)]
    assert _found(f"{before}{blank}{blank.join(wrong)}{blank}{after}", p)[0, 0] >= 50


def test_pages_in_other_scripts_as_a_table(spark):
    alphabet = SCRIPTS["cyrillic"][0]
    p = " ".join(_made(1, 38, alphabet))
    docs = spark.createDataFrame([(1, p), (2, " ".join(_made(5, 300, alphabet))), (3, "x\x00" + p)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, p)], "item_id bigint, passage string")
    assert {(r.doc_id, r.item_id, r.n_words) for r in leaks(docs, items).collect()} == {(1, 7, 38), (3, 7, 38)}


def test_a_passage_over_many_codes_of_a_long_page_is_one(monkeypatch):
    import traceloom.llm.leaks as m

    words = _text(1, 4000)
    page = " ".join(_text(50, 500)) + " " + " ".join(words) + " " + " ".join(_text(51, 500))
    whole = _found(page, " ".join(words))
    monkeypatch.setattr(m, "SCANNED", 5000)
    assert _found(page, " ".join(words)) == whole == {(0, 0): 4000}
