"""Pages of repeated keywords, links or product tags in place of prose.

For each page the words are counted and ranked by frequency; SQL windows and aggregations fit the line log frequency over log rank (equal
frequencies at their mean rank) and give its slope and residual, and the divergence of the page's words from its language's. Links and tags have no
list of their own: a token built like one (names joined by dots or slashes, mark-up, a sign before a name) counts as one more word, ``MARK``, of the page,
so a page of links is a page that repeats this word. A page whose slope, residual or divergence is extreme among pages of its language and length is a
suspect, and so is one that repeats itself, whatever the others do. Copies of a page count once and pages suspect by themselves not at all in what is
usual, so that stuffed pages, however many, are not measured against each other. The words that make a suspect's divergence, far more frequent
on it than in its language, are its keywords; suspects alone are then read word by word, and the share of words among keywords repeated at short
distance decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.leaks import in_reading_order, near, page_layout
from traceloom.session import broadcast_if_bounded, materialize

#: Spreads (median minus lower quartile) beyond the median of like pages from which a page is a suspect; pages a group needs to be a standard.
SPREADS, GROUP = 3.0, 30
#: Chance that two words of a page are the same (of three letters or more), from which it is a suspect by itself.
REPEATS = 0.02
#: Share of a language's pages a word must be on to be in its vocabulary, and the frequency of all other words.
ON_PAGES, RARE = 0.001, 1e-5
#: A keyword: at least so often on the page, so many times its frequency in the language, within so many words of itself.
TIMES, EXCESS, REACH = 3, 6.0, 16
#: Words to either side that decide with a word, and the share of marked ones that makes it belong.
AROUND, DENSE = 4, 0.4
#: Shares at which misread keywords are looked for.
UNCLEAR = (0.1, 0.6)
#: The word that every token built like a link or a tag counts as.
MARK = "://"
_BUILT = r"(?:(?<!L)L{2,}+(?:[-0-9]*+[./:@?&=+_~\\][-0-9./:@?&=+_~\\]*+L|[0-9]{3})|</?L|(?<=L)>|(?<=L)[=(]+[\"'<]|\](?=\()|(?<=\s)\W?[#@]L)\S*+"
#: Names joined by the signs of addresses, a name that runs into a number, mark-up, or a sign that makes a name a tag.
BUILT_SQL, BUILT = (_BUILT.replace("L", r"\p{L}"), re.compile(_BUILT.replace("L", r"[^\W\d_]")))
NUMBER = re.compile(r"^\W*\d[\d.,:½¼¾]*\W*$")
BROKEN = "[-­¬‐‑=]\\s*[\\n\\r\u0085 \\x0b\\x0c]+\\s*"
_FROM = "ſàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
_TO = "saaaaaaceeeeiiiinoooooouuuuyy"


def whole_words(text: Column) -> Column:
    """A text with broken lines joined."""
    return F.regexp_replace(text, BROKEN, "")


def words(text: Column) -> Column:
    """The words of a text in a plain form, as an array: broken lines joined, lower case, letters and digits only, accents and plural s off.

    Other signs part words, but for apostrophes and accents.
    """
    return _split(whole_words(text))


def _split(whole: Column) -> Column:
    plain = F.translate(F.lower(whole), _FROM + "ﬂﬁ'’‘´`", _TO + "ff")
    only = F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.regexp_replace(only, r"s+(?= |$)", ""), " "), lambda w: w != "")


def built_marks(whole: Column) -> Column:
    """A ``MARK`` for each token built like a link or a tag, as an array."""
    return F.array_repeat(F.lit(MARK), F.regexp_count(F.concat(F.lit(" "), whole), F.lit(BUILT_SQL)))


def plain_words(token: str) -> list[str]:
    """``words`` for a single token, without marks."""
    x = unicodedata.normalize("NFC", token).lower().translate(_TABLE)
    parts = "".join(c if c.isalnum() else "" if unicodedata.category(c)[0] == "M" else " " for c in x).split()
    return [p for w in parts if (p := w.rstrip("s"))]


def plain_word(w: str) -> str:
    """The parts of a token as one."""
    return "".join(plain_words(w))


_TABLE = {ord(a): b for a, b in zip(_FROM + "ﬂﬁ", _TO + "ff")} | dict.fromkeys(map(ord, "'’‘´`"))


def _language(lang: str) -> Column:
    return F.lower(F.coalesce(F.trim(lang), F.lit("und"))).alias("lang")


#: What tells pages apart.
PAGE = ["key", "lang"]


def page_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, lang, word, f)``: how often each word is on each page, a page being a key and its language. One shuffle lays pages out by key; their words need no other."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return _counted(rows.select(F.col(key).alias("key"), _language(lang), F.col(text).alias("text")))


def _counted(pages: DataFrame) -> DataFrame:
    whole = pages.repartition("key").select("key", "lang", whole_words(F.col("text")).alias("whole"))
    listed = whole.select("key", "lang", F.explode(F.concat(_split(F.col("whole")), built_marks(F.col("whole")))).alias("word"))
    return listed.groupBy(*PAGE, "word").agg(F.count(F.lit(1)).cast("int").alias("f"))


def _identity(lang: Column, text: Column) -> Column:
    """The number of a text in its language: one for all its copies."""
    return F.xxhash64(lang, text)


def folded_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``page_counts`` of the different texts of each language; their key is ``_identity``. Copies are folded before texts move, so many are no task of their own."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    texts = rows.select(_language(lang), F.col(text).alias("text")).distinct()
    return _counted(texts.select(_identity(F.col("lang"), F.col("text")).alias("key"), "lang", "text"))


def page_sizes(counts: DataFrame) -> DataFrame:
    """``(key, lang, n, alone)``: the words of each page, and whether the page is suspect by itself: it repeats its own words (``MARK`` is one)."""
    f = F.col("f").cast("bigint")
    again = F.sum(F.when(F.length("word") >= 3, f * (f - 1)).otherwise(0))
    n = F.sum(f)
    alone = (again >= F.lit(REPEATS) * n * (n - 1)) & (again > 0)
    return counts.groupBy(*PAGE).agg(n.alias("n"), alone.alias("alone"))


def vocabulary(counts: DataFrame, on_pages: float = ON_PAGES, pages: DataFrame | None = None) -> DataFrame:
    """``(lang, word, q)``: frequencies of the words on at least ``on_pages`` of a language's pages; lang ``*`` is all languages.

    ``pages``: ``page_sizes``; with them, pages suspect by themselves are left out, but not in a language with fewer than ``GROUP`` others. The size of the result is bounded by the words on an average page divided by ``on_pages``, for each language.
    """
    if pages is None:
        pages = counts.groupBy(*PAGE).agg(F.sum("f").alias("n"))
    else:
        enough = pages.groupBy("lang").agg(F.sum((~F.col("alone")).cast("int")).alias("_others")).where(F.col("_others") >= GROUP).select("lang")
        out = materialize(pages.where("alone").join(F.broadcast(enough), "lang", "left_semi").select(*PAGE))
        hint = broadcast_if_bounded(out)
        counts, pages = counts.join(hint, PAGE, "left_anti"), pages.join(hint, PAGE, "left_anti")
    per = materialize(counts.groupBy("lang", "word").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("pages")).where("pages > 1"))
    sizes = pages.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("all_pages"))
    sizes = materialize(sizes)
    each = per.join(F.broadcast(sizes), "lang")  # one row per language
    every = per.groupBy("word").agg(F.sum("f").alias("f"), F.sum("pages").alias("pages")).crossJoin(F.broadcast(sizes.agg(F.sum("total").alias("total"), F.sum("all_pages").alias("all_pages"))))
    both = each.select("lang", "word", "f", "pages", "total", "all_pages").unionByName(every.select(F.lit("*").alias("lang"), "word", "f", "pages", "total", "all_pages"))
    kept = both.where(F.col("pages") >= F.lit(on_pages) * F.col("all_pages"))
    return materialize(kept.select("lang", "word", F.greatest(F.col("f") / F.col("total"), F.lit(RARE)).alias("q")))


def page_curves(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(key, lang, n, types, slope, residual, divergence)`` per page.

    slope and residual of log frequency over log rank; a page of one frequency only has slope 0 and residual 0. divergence: relative entropy of the
    page's words against its language, in nats.
    """
    own = broadcast_if_bounded(vocab.where("lang <> '*'"))
    rated = counts.join(own, ["lang", "word"], "left").withColumn("q", F.coalesce("q", F.lit(RARE)))
    sums = rated.groupBy(*PAGE).agg(
        F.sum("f").alias("n"), F.count(F.lit(1)).alias("types"), F.sum(F.col("f") * F.log("f")).alias("_flogf"), F.sum(F.col("f") * F.log("q")).alias("_flogq")
    )
    spectrum = counts.groupBy(*PAGE, "f").agg(F.count(F.lit(1)).alias("k"))
    down = Window.partitionBy(*PAGE).orderBy(F.desc("f"))
    ranked = spectrum.withColumn("_r", F.sum("k").over(down) - (F.col("k") - 1) / 2)
    x, y, k = F.log("_r"), F.log("f"), F.col("k")
    moments = ranked.groupBy(*PAGE).agg(*[F.sum(k * e).alias(name) for name, e in (("w", F.lit(1.0)), ("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y))])
    cxx, cxy, cyy = F.expr("sxx - sx * sx / w"), F.expr("sxy - sx * sy / w"), F.expr("syy - sy * sy / w")
    slope = F.when(cxx > 1e-9, cxy / cxx).otherwise(0.0)
    residual = F.sqrt(F.greatest(F.lit(0.0), (cyy - slope * cxy) / F.col("w")))
    fitted = moments.select(*PAGE, slope.alias("slope"), residual.alias("residual"))
    apart = F.col("_flogf") / F.col("n") - F.log("n") - F.col("_flogq") / F.col("n")
    return sums.select(*PAGE, "n", "types", apart.alias("divergence")).join(fitted, PAGE)


def suspects(curves: DataFrame, spreads: float = SPREADS, group: int = GROUP, pages: DataFrame | None = None) -> DataFrame:
    """The rows of ``curves`` that are extreme among the pages of their language and of a length within a power of two.

    Groups of fewer than ``group`` pages set no standard: all their pages are suspects. With ``pages`` (``page_sizes``), those suspect by themselves are
    suspects too and no part of the standard.
    """
    sized = curves.withColumn("_size", F.floor(F.log2("n")).cast("int"))
    if pages is None:
        sized = sized.withColumn("_alone", F.lit(False))
    else:
        marked = pages.where("alone").select(*PAGE, F.lit(True).alias("_alone"))
        sized = sized.join(broadcast_if_bounded(marked), PAGE, "left").withColumn("_alone", F.coalesce("_alone", F.lit(False)))
    q = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 1000)
    usual = sized.where(~F.col("_alone")).groupBy("lang", "_size").agg(F.count(F.lit(1)).alias("_pages"), q("divergence").alias("_d"), q("slope").alias("_s"), q("residual").alias("_e"))
    both = sized.join(F.broadcast(usual), ["lang", "_size"], "left")  # a row per language and power of two

    def over(value: str, limits: str) -> Column:
        v, at = F.col(value), F.col(limits)
        return v > at[1] + spreads * F.greatest(at[1] - at[0], F.lit(0.02))

    def under(value: str, limits: str) -> Column:
        v, at = F.col(value), F.col(limits)
        return v < at[1] - 2 * spreads * F.greatest(at[2] - at[1], F.lit(0.02))

    steep = under("slope", "_s") & (F.col("divergence") > F.col("_d")[2])
    rough = (F.col("residual") > F.col("_e")[1] + 4 * spreads * F.greatest(F.col("_e")[1] - F.col("_e")[0], F.lit(0.01))) & (F.col("divergence") > F.col("_d")[2])
    return both.where(F.col("_alone") | F.col("_pages").isNull() | (F.col("_pages") < group) | over("divergence", "_d") | steep | rough).select(*curves.columns)


def keywords(counts: DataFrame, chosen: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(key, kw)``: of the chosen pages ``(key, lang, n)``, the words far more frequent there than in their language and overall."""
    few = counts.where(F.col("f") >= TIMES).join(broadcast_if_bounded(chosen.select(*PAGE, "n")), PAGE)
    own = broadcast_if_bounded(vocab.where("lang <> '*'"))
    alle = broadcast_if_bounded(vocab.where("lang = '*'").select("word", F.col("q").alias("_all")))
    rated = few.join(own, ["lang", "word"], "left").join(alle, "word", "left")
    usual = F.greatest(F.coalesce("q", F.lit(RARE)), F.coalesce("_all", F.lit(RARE)))
    high = (F.length("word") >= 3) & ~F.col("word").rlike(r"^\d+$") & (F.col("f") >= F.lit(EXCESS) * usual * F.col("n"))
    return rated.where(high).groupBy(*PAGE).agg(F.collect_set("word").alias("kw"))


_BROKEN = re.compile(BROKEN)


def stuffed_share(text: str | None, kw: set[str], misread: bool = False) -> float:
    """The share of a page's words that belong to keywords ``kw`` repeated at short distance; 0 without words.

    If ``MARK`` is a keyword, so is every token built like a link or a tag. Words among numbers (tables of prices or times) are no keywords. A word belongs
    if enough of the words around it are marked, so that places named between keywords count with them and a single link in an article counts
    little. ``misread``: words that differ from a keyword by a letter, or two in longer ones, count as that keyword.
    """
    if not text:
        return 0.0
    toks = [x for x in _BROKEN.sub("", text).split() if any(c.isalnum() for c in x)]
    n = len(toks)
    if not n:
        return 0.0
    numbers = [0]
    for x in toks:
        numbers.append(numbers[-1] + bool(NUMBER.match(x)))
    long = [k for k in kw if len(k) >= 5] if misread else []
    marked, last = bytearray(n), {}
    built = MARK in kw
    for j, x in enumerate(toks):
        if built and BUILT.search(" " + x):
            marked[j] = 1
        if kw and numbers[min(n, j + 6)] - numbers[max(0, j - 5)] < 2:
            parts = plain_words(x)
            here = [w for w in parts if w in kw]
            if not here:
                w = "".join(parts)
                here = [w] if w in kw else [k for k in long if near(w, k, 1 if len(k) < 9 else 2)][:1] if long and len(w) >= 4 else ()
            for w in here:
                p = last.get(w)
                if p is not None and j - p <= REACH:
                    marked[j] = marked[p] = 1
                last[w] = j
    sums = [0]
    for m in marked:
        sums.append(sums[-1] + m)
    inside = 0
    for j in range(n):
        a, b = max(0, j - AROUND), min(n, j + AROUND + 1)
        inside += sums[b] - sums[a] >= DENSE * (b - a)
    return inside / n


def page_share(text: str | None, kw: set[str]) -> float:
    """``stuffed_share``; where that is not clear, with misread keywords counted too."""
    share = stuffed_share(text, kw)
    return stuffed_share(text, kw, True) if UNCLEAR[0] <= share <= UNCLEAR[1] else share


def stuffed_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = 0.5) -> DataFrame:
    """``(key, n, slope, residual, divergence, share)``: pages with more than ``share`` of their words stuffed.

    Null, empty and blank texts have no words and are never found; rows with a null key are left out; equal texts of a language are one page to
    the counts, whatever their keys; every row has its own verdict, and a key is reported once. An unknown language (null) is a language of its own. Other columns are not read. The words of a page are one
    group; a page is a bounded record. Where the table has ``n_columns`` and ``line_boxes``, suspects are read as their columns run.
    """
    counts = materialize(folded_counts(docs, key, text, lang))
    pages = materialize(page_sizes(counts))
    vocab = vocabulary(counts, pages=pages)
    curves = materialize(page_curves(counts, vocab))
    odd = materialize(suspects(curves, pages=pages))
    marks = materialize(odd.join(keywords(counts, odd, vocab), PAGE, "left"))
    read = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), _language(lang), F.col(text).alias("text"), *page_layout(docs))
    identified = read.withColumn("_id", _identity(F.col("lang"), F.col("text")))
    texts = identified.join(broadcast_if_bounded(marks.withColumnRenamed("key", "_id")), ["_id", "lang"])
    kind = docs.schema[key].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column("kw")
            shares = [page_share(t, set(k[i].as_py() or ())) for i, t in enumerate(in_reading_order(b.column("text"), b.column("n_columns"), b.column("boxes")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "n", "slope", "residual", "divergence")), pa.array(shares, pa.float64())], ["key", "n", "slope", "residual", "divergence", "share"])

    rated = texts.select("key", "n", "slope", "residual", "divergence", "text", "n_columns", "boxes", "kw").mapInArrow(check, f"key {kind}, n bigint, slope double, residual double, divergence double, share double")
    return rated.where(F.col("share") > share).dropDuplicates(["key"]).withColumnRenamed("key", key)
