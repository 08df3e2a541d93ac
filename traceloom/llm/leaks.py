"""Passages of test material inside a corpus, whole or in part.

Pages are put into reading order by their line boxes and reduced to a stream of letters and digits of any script, so case, punctuation, hyphens and
line breaks do not matter. Search strings are the twelve-letter windows of the passages that few passages share. A page's stream is scanned with
Wu-Manber's tables: only the blocks at visited positions are hashed; a block's shift passes over positions where no string can end, a block with shift 0
leads to the bucket of strings that end in blocks of its hash, and these are compared directly. All lanes of a batch step together as arrays.
Where enough strings of one passage lie on one diagonal, the passage is followed word by word to both sides, allowing misread words and adverts
set between, and the longest stretch that holds is reported.

Scripts without blanks have no written words: a Chinese character or a kana counts as a word of ``IDEOGRAPH`` letters (all but one of them the same filler,
so that another character is a misread word and not a lost one), and Thai, Lao, Burmese and Khmer are cut into words of ``UNSPACED`` letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import collect_bounded

#: Letters of a search string, of a block; entries of the shift table and of the table of buckets (powers of two).
WINDOW, BLOCK, TABLE, BUCKETS = 12, 6, 1 << 22, 1 << 18
#: Letters a character of a script of whole-word characters counts as, and of a word in other scripts without blanks.
IDEOGRAPH, UNSPACED = 5, 4
#: A string of more passages than this is searched only where a stretch of ``MIN_WORDS`` words would else have fewer than ``STRINGS`` of them.
SHARED, STRINGS = 3, 24
#: Letters of a passage covered by strings on one diagonal (within ``SLACK`` letters) from which the passage is followed on the page.
COVERED, SLACK = 30, 16
#: Letters without a string after which a diagonal is followed anew.
BREAK = 64
#: Words that must run on; the share of them that may be misread, and that may not be recognisable at all.
MIN_WORDS, MISREAD, LOST = 22, 0.3, 0.06
#: Misread words at the ends of a stretch cannot be told from words outside it; so many of ``MIN_WORDS`` may be missing.
EDGE = 2
#: Letters of matter set between, at most, at one place.
ADVERT = 320
#: Test passages the driver holds: test material is a fixed, small set.
ITEMS = 50_000
#: Codes of one lane.
LANE = 1024
#: Characters read together, and codes scanned at a time; a longer page is one stream all the same.
PART, SCANNED = 1 << 20, 1 << 21

_SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ς": "σ"}
#: What stands for the letters an ideograph counts as besides itself: a private character, which no text keeps.
FILLER = 0xE000
_IDEOGRAPHS = ((0x3005, 0x3007), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))
#: Multipliers of a block's letters, and of the mixing after.
_MULTIPLY = np.random.default_rng(11).integers(1, 2**63, BLOCK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _kinds() -> np.ndarray:
    """By code point: 0 is left out, 1 a letter or digit, 2 an ideograph, 3 a letter of a script without blanks."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[i for i in range(0x32400) if unicodedata.category(chr(i))[0] in "LN"]] = 1
    kinds[0x02B0:0x0300] = kinds[0x0640] = 0  # modifiers, and the stroke that stretches Arabic words
    for code, ranges in ((2, _IDEOGRAPHS), (3, _UNSPACED)):
        for lo, hi in ranges:
            part = kinds[lo : hi + 1]
            part[part > 0] = code
    return kinds


def codes(text: str) -> np.ndarray:
    """Letters and digits of any script as code points, case, accents and vowel signs off; NUL is 0; everything else is left out."""
    plain = text.lower()
    if not plain.isascii():
        for a, b in _SPECIAL.items():
            plain = plain.replace(a, b)
        plain = unicodedata.normalize("NFKD", plain)
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[points]
    keep = (kinds > 0) | (points == 0)
    c, kinds = points[keep], kinds[keep]
    ideographs = kinds == 2
    if not ideographs.any():
        return c
    at = np.cumsum(np.where(ideographs, IDEOGRAPH, 1))
    out = np.full(at[-1], FILLER, np.uint32)
    out[at - 1] = c
    return out


def _string(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def letters(text: str) -> str:
    return _string(codes(text)).replace("\x00", "")


_GAP = re.compile(r"\s*\t\s*|\s{2,}|\s+[|¦‖│]\s+")


def reading_order(text: str, n_columns: int | None, boxes: list | np.ndarray | None) -> str:
    """The lines of a page as its columns run. ``boxes``: (x0, y0, x1, y1) per line; without them, or with one column, the text as it is.

    A line that holds several columns side by side (its box is wider than a column) is cut at tabs, runs of blanks and rules.
    """
    if not n_columns or n_columns < 2 or boxes is None:
        return text
    lines = text.split("\n")
    if len(lines) != len(boxes) or len(lines) < 2:
        return text
    b = np.asarray(boxes)
    left = b[:, 0].min()
    pitch = (b[:, 2].max() - left) / n_columns
    if pitch <= 0:
        return text
    at = np.clip(((b[:, 0] - left) / pitch + 0.3).astype(int), 0, n_columns - 1)
    wide = (b[:, 2] - b[:, 0]) > 1.4 * pitch
    if not wide.any():
        return "\n".join([lines[i] for i in np.lexsort((b[:, 1], at)).tolist()])
    parts: list[list[tuple[int, str]]] = [[] for _ in range(n_columns)]
    for i in np.argsort(b[:, 1], kind="stable").tolist():
        pieces = [p for p in _GAP.split(lines[i].strip()) if p] if wide[i] else [lines[i]]
        for k, p in enumerate(pieces):
            parts[min(int(at[i]) + k, n_columns - 1)].append(p)
    return "\n".join("\n".join(p) for p in parts)


@dataclass
class Passage:
    item: int
    text: str  # letters only
    starts: list[int]  # of words, in letters
    ends: list[int]
    windows: frozenset = field(default_factory=frozenset)
    reverse: frozenset = field(default_factory=frozenset)  # the windows read backwards


def passage(item: int, text: str) -> Passage | None:
    """A passage by its words; none if it has no letter."""
    starts, ends, out, at = [], [], [], 0
    for w in text.split():
        for x in _words(letters(w)):
            starts.append(at)
            at += len(x)
            ends.append(at)
            out.append(x)
    whole = "".join(out)
    windows = frozenset(whole[i : i + WINDOW] for i in range(len(whole) - WINDOW + 1))
    return Passage(item, whole, starts, ends, windows, frozenset(w[::-1] for w in windows)) if out else None


def _words(x: str) -> Iterator[str]:
    """What stands between two blanks as words: one, but for scripts without blanks."""
    if not x or x.isascii():
        yield from [x] if x else []
        return
    kinds = _kinds()
    for kind, run in groupby(x, lambda c: 2 if ord(c) == FILLER else int(kinds[ord(c)])):
        part = "".join(run)
        size = IDEOGRAPH if kind == 2 else UNSPACED if kind == 3 else len(part)
        yield from (part[i : i + size] for i in range(0, len(part), size))


class Patterns:
    """The search strings of a set of passages and Wu-Manber's tables over them."""

    def __init__(self, passages: list[Passage], min_words: int = MIN_WORDS):
        self.passages = passages
        where: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(passages):
            for i in range(len(p.text) - WINDOW + 1):
                where.setdefault(p.text[i : i + WINDOW], []).append((k, i))
        owners = {w: len({k for k, _ in v}) for w, v in where.items()}
        chosen = {w for w, n in owners.items() if n <= SHARED}
        for p in passages:
            words = len(p.starts)
            for a in range(max(1, words - min_words + 1)):
                lo, hi = p.starts[a], p.ends[min(words, a + min_words) - 1] - WINDOW
                inside = [p.text[i : i + WINDOW] for i in range(lo, hi + 1)]
                lack = STRINGS - sum(w in chosen for w in inside)
                if lack > 0:
                    chosen.update(sorted((w for w in inside if w not in chosen), key=lambda w: (owners[w], w))[:lack])
        texts = [np.frombuffer(p.text.encode("utf-32-le", "surrogatepass"), np.uint32) for p in passages]
        first = np.cumsum([0, *(len(t) for t in texts)])
        #: the passages' letters, one after the other; a search string is a place in them
        self.text = np.concatenate([*texts, np.zeros(1, np.uint32)])
        names = sorted(chosen)
        place = np.array([first[where[w][0][0]] + where[w][0][1] for w in names], np.int64)
        self.shift = np.full(TABLE, WINDOW - BLOCK + 1, np.int8)
        for end in range(BLOCK, WINDOW + 1):
            np.minimum.at(self.shift, block_hash(self.text, place + end - BLOCK), np.int8(WINDOW - end))
        bucket = block_hash(self.text, place + WINDOW - BLOCK) % BUCKETS
        order = np.argsort(bucket, kind="stable")
        #: strings in the order of the buckets of their last blocks, and where each bucket begins
        self.place = place[order].astype(np.int32)
        self.bucket = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).astype(np.int32)
        occ = [where[names[i]] for i in order.tolist()]
        self.offsets = np.concatenate([[0], np.cumsum([len(o) for o in occ])]).astype(np.int64)
        flat = [x for o in occ for x in o]
        self.owner = np.array([k for k, _ in flat], np.int64)
        self.at = np.array([i for _, i in flat], np.int64)


def block_hash(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the blocks that start at the given places, below ``TABLE``."""
    h = stream[at] * _MULTIPLY[0]
    for k in range(1, BLOCK):
        h += stream[at + k] * _MULTIPLY[k]
    h ^= h >> np.uint64(31)
    h *= _MULTIPLY[0]
    return (h >> np.uint64(64 - TABLE.bit_length() + 1)).astype(np.int64)


def scan(stream: np.ndarray, pat: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """``(start positions, string numbers)`` of all search strings in a stream of codes; a 0 is in no string."""
    none = np.zeros(0, np.int64)
    got = [(none, none)]
    if len(pat.place):
        for lo in range(0, len(stream), SCANNED):
            start, slot = _scan(stream[lo : lo + SCANNED + WINDOW - 1], pat)
            got.append((start + lo, slot))
    return tuple(np.concatenate(x) for x in zip(*got))


def _scan(stream: np.ndarray, pat: Patterns) -> tuple[np.ndarray, np.ndarray]:
    n = len(stream) - BLOCK + 1
    pos = np.arange(WINDOW - BLOCK, n, LANE)  # of the block that would end a string
    stop = np.minimum(pos + LANE, n)
    ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(pos):
        h = block_hash(stream, pos)
        s = pat.shift[h]
        hit = s == 0
        ends.append(pos[hit])
        hashes.append(h[hit])
        pos = pos + np.maximum(s, 1)
        live = pos < stop
        if not live.all():
            pos, stop = pos[live], stop[live]
    start = np.concatenate(ends) - (WINDOW - BLOCK)
    bucket = np.concatenate(hashes) % BUCKETS
    lo = pat.bucket[bucket].astype(np.int64)
    n = pat.bucket[bucket + 1] - lo
    slot = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(start, n)
    for k in range(WINDOW):
        same = stream[start + k] == pat.text[pat.place[slot] + k]
        start, slot = start[same], slot[same]
    return start, slot


def candidates(stream: np.ndarray, bounds: np.ndarray, pat: Patterns) -> list[tuple[int, int, int, int]]:
    """``(page, passage, position on the page, position in the passage)``: one anchor per stretch of a diagonal with enough strings on it."""
    start, slot = scan(stream, pat)
    if not len(start):
        return []
    n = pat.offsets[slot + 1] - pat.offsets[slot]
    idx = np.repeat(pat.offsets[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = np.repeat(start, n)
    page = np.searchsorted(bounds, pos, "right") - 1
    j, k, q = pos - bounds[page], pat.owner[idx], pat.at[idx]
    out = {}
    for off in (0, SLACK // 2):
        bin_ = (j - q + off + (1 << 12)) // SLACK
        sizes = (len(bounds) + 1, len(pat.passages), int(bin_.max()) + 1, int(q.max()) + 1)
        if np.prod([float(x) for x in sizes]) < 2**62 and bin_.min() >= 0:
            group = (page * sizes[1] + k) * sizes[2] + bin_
            order = np.argsort(group * sizes[3] + q)
        else:
            group = None
            order = np.lexsort((q, bin_, k, page))
        qq = q[order]
        fresh = np.ones(len(order), bool)
        if group is not None:
            g = group[order]
            fresh[1:] = g[1:] != g[:-1]
        else:
            fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (page, k, bin_)], axis=0)
        fresh[1:] |= qq[1:] - qq[:-1] > BREAK
        gain = np.full(len(order), WINDOW)
        gain[1:] = np.where(fresh[1:], WINDOW, np.minimum(WINDOW, qq[1:] - qq[:-1]))
        at = np.flatnonzero(fresh)
        cover = np.add.reduceat(gain, at)
        for g in np.flatnonzero(cover >= COVERED).tolist():
            lo, hi = at[g], at[g + 1] if g + 1 < len(at) else len(order)
            i = order[(lo + hi) // 2]
            out.setdefault((int(page[i]), int(k[i]), int(j[i] - q[i]) // SLACK, int(q[i]) // BREAK), (int(page[i]), int(k[i]), int(j[i]), int(q[i])))
    return list(out.values())


def near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` letters differ, are missing or added."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            diag, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, diag + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _prefix(w: str, text: str, most: int) -> tuple[int, int]:
    """``(errors, letters)``: the start of ``text`` that is nearest to ``w``."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(w, 1):
        diag, row[0] = row[0], i
        for k, y in enumerate(text, 1):
            diag, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, diag + (x != y))
    best = min(row)
    if best > most:
        return best, 0
    return best, min((k for k, v in enumerate(row) if v == best), key=lambda k: abs(k - len(w)))


def follow(doc: str, j: int, text: str, words: list[tuple[int, int]], windows: frozenset) -> list[int]:
    """How each word of ``words`` is found on the page from position ``j`` on: 0 as it is, 1 misread, 2 not recognisable, 3 another ideograph.

    Ends where the trail is lost. An ideograph has no letters to recognise it by: another one in its place may be a misread one inside a stretch, but no end of it.

    ``text`` and ``words`` are the passage's letters and the spans of its words from the trail's start; ``windows`` its search windows (matter set between is
    passed over only if none of them is in it).
    """
    out: list[int] = []
    lost = 0
    for n, (a, b) in enumerate(words):
        w = text[a:b]
        size = b - a
        if doc.startswith(w, j):
            out.append(0)
            j += size
            lost = 0
            continue
        most = 1 if size <= 4 else 2 if size <= 9 else 3
        ahead = text[b : b + 10]
        r = doc.find(ahead, max(j, j + size - most), j + size + most + 10) if len(ahead) >= 8 else -1
        if r >= 0 and r - j <= size + most and (size <= 3 or near(w, doc[j:r], most)):
            out.append(2 if w.isdigit() and doc[j:r].isdigit() else 1)  # another number is no misread one
            j = r
            lost = 0
            continue
        jump = _advert(doc, j, text, words, n, windows)
        if jump is not None:
            j, misread = jump
            out.append(misread)
            lost = 0
            continue
        errors, took = _prefix(w, doc[j : j + size + 2], most)
        if errors <= most and took:
            out.append(1)
            j += took
            lost = max(0, lost - 1)
        elif r >= 0:
            out.append(2)
            j = r
            lost += 1
        else:
            out.append(2)
            j += size
            lost += 2
        if lost > 3:
            while out and out[-1]:
                out.pop()
            break
    filler = chr(FILLER)
    return [3 if s and filler in text[a:b] else s for s, (a, b) in zip(out, words)] if filler in text else out


def _advert(doc: str, j: int, text: str, words: list[tuple[int, int]], n: int, windows: frozenset) -> tuple[int, int] | None:
    """``(position after the word, 0 or 1)`` if word ``n`` stands behind matter set between, whole (perhaps misread) or cut in two by it.

    It is recognised by the letters that follow it, or, if these are misread too, by those after the next word. None of the passage's own strings may
    be in the matter.
    """
    a, b = words[n]
    w = text[a:b]
    for s in (a, b, words[n + 1][1] if n + 1 < len(words) else b):
        ahead = text[s : s + WINDOW]
        if len(ahead) < WINDOW:
            continue
        r = doc.find(ahead, j + (s - a) + 1, j + (s - a) + ADVERT + WINDOW)
        if r < 0:
            continue
        if any(doc[i : i + WINDOW] in windows for i in range(j, r - (s - a) - WINDOW + 1)):
            return None
        if s == a:
            return r + len(w), 0
        end = r - (s - b)  # where the word ends
        if near(w, doc[max(j, end - len(w)) : end], 1 if len(w) <= 4 else 2):
            return end, 1
        if end - j > len(w) + WINDOW and any(doc.startswith(w[:x], j) and doc.endswith(w[x:], j, end) for x in range(1, len(w))):
            return end, 1
    return None


def longest(states: list[int], misread: float = MISREAD, lost: float = LOST) -> int:
    """The most words in a row of which at most these shares are not as printed, and not recognisable."""
    bad, gone = [0], [0]
    for s in states:
        bad.append(bad[-1] + (s > 0))
        gone.append(gone[-1] + (s == 2))
    n, best = len(states), 0
    for a in range(n):
        if states[a]:
            continue
        for b in range(n, a + best, -1):
            size = b - a
            if states[b - 1] < 3 and bad[b] - bad[a] <= misread * size and gone[b] - gone[a] <= lost * size:
                best = size
                break
    return best


def matched_words(doc: str, p: Passage, j: int, q: int) -> int:
    """The longest stretch of the passage on the page through the common letters at ``j`` and ``q``."""
    k = next((i for i, s in enumerate(p.starts) if s >= q), len(p.starts))
    spans = list(zip(p.starts, p.ends))
    n = len(p.text)
    shift = (p.starts[k] if k < len(p.starts) else n) - q
    right = follow(doc, j + shift, p.text, spans[k:], p.windows)
    back = [(n - e, n - s) for s, e in reversed(spans[:k])]
    left = follow(doc[::-1], len(doc) - (j + shift), p.text[::-1], back, p.reverse)
    return longest([*reversed(left), *right])


def page_leaks(texts: list[str], pat: Patterns, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """``(page, item, words)`` of pages in reading order."""
    if not texts:
        return
    stream = codes("\x00".join(t.replace("\x00", " ") if "\x00" in t else t for t in texts))
    cuts = np.flatnonzero(stream == 0)
    bounds = np.concatenate([[0], cuts + 1])
    best: dict[tuple[int, int], int] = {}
    for page, k, j, q in candidates(stream, bounds, pat):
        if best.get((page, k), 0) >= len(pat.passages[k].starts):
            continue
        p = pat.passages[k]
        # as far as the passage can reach with matter set between all its words
        lo, hi = bounds[page], cuts[page] if page < len(cuts) else len(stream)
        far = 2 * len(p.text) + (len(p.starts) + 1) * (ADVERT + WINDOW)
        a, b = max(lo, lo + j - far), min(hi, lo + j + far)
        n = matched_words(_string(stream[a:b]), p, int(lo + j - a), q)
        if n > best.get((page, k), 0):
            best[page, k] = n
    for (page, k), n in best.items():
        if n >= min_words - EDGE:
            yield page, pat.passages[k].item, n


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PART`` characters; a longer text is a range of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > PART:
            yield first, i
            first, size = i, 0
        size += len(t)
    yield first, len(texts)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """``(key, item_id, n_words)``: pages that print at least ``min_words`` consecutive words of a test passage, one row per page and item.

    ``docs`` has ``key, text, n_columns, line_boxes`` (boxes with x0, y0, x1, y1; null boxes or columns: the text is read as it is), ``items`` has
    ``item_id, passage``. Null keys, null and empty texts and null passages give no rows; passages shorter than ``min_words`` words are found only
    nearly whole; a row repeated gives its result once; other columns are not read. Test items are a stated query set, collected up to a
    checked bound and broadcast; pages are not shuffled, each batch is scanned as it is read.
    """
    got = collect_bounded(items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").distinct(), ITEMS, "test items")
    spark = docs.sparkSession
    pat = spark.sparkContext.broadcast(Patterns([p for r in sorted(got) if (p := passage(r[0], r[1]))], min_words))
    pages = docs.where(F.col(key).isNotNull() & (F.length("text") > 0)).select(F.col(key).alias("key"), "text", *page_layout(docs))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = pat.value
        for b in batches:
            if not b.num_rows:
                continue
            texts = in_reading_order(b.column(1), b.column(2), b.column(3))
            rows: dict[tuple[int, int], int] = {}
            for lo, hi in _together(texts):
                rows.update(((lo + i, item), n) for i, item, n in page_leaks(texts[lo:hi], patterns, min_words))
            found = sorted(rows)
            keys = b.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([k for _, k in found], pa.int64()), pa.array([rows[x] for x in found], pa.int32())], ["key", "item_id", "n_words"])

    found = pages.mapInArrow(run, f"key {kind}, item_id bigint, n_words int")
    return found.groupBy("key", "item_id").agg(F.max("n_words").alias("n_words")).withColumnRenamed("key", key)


def page_layout(docs: DataFrame) -> list:
    """``n_columns, boxes`` (four numbers a line, only for pages of several columns) as columns to select; nulls where the table has neither."""
    if not {"n_columns", "line_boxes"} <= set(docs.columns):
        return [F.lit(None).cast("int").alias("n_columns"), F.lit(None).cast("array<int>").alias("boxes")]
    flat = F.flatten(F.transform("line_boxes", lambda x: F.array(x["x0"], x["y0"], x["x1"], x["y1"])))
    return [F.col("n_columns").cast("int").alias("n_columns"), F.when(F.col("n_columns") > 1, flat).alias("boxes")]


def in_reading_order(texts: pa.Array, columns: pa.Array, boxes: pa.Array) -> list[str]:
    """Arrow columns of texts and ``page_layout`` as texts in reading order; a page with a missing number in its boxes is read as it is."""
    offsets = boxes.offsets.to_numpy()
    values = boxes.values
    sound = values.is_valid().to_numpy(zero_copy_only=False)
    grid = values.fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for i, (t, n) in enumerate(zip(texts.to_pylist(), columns.to_pylist())):
        lo, hi = offsets[i], offsets[i + 1]
        whole = hi > lo and (hi - lo) % 4 == 0 and sound[lo:hi].all()
        out.append(reading_order(t, n, grid[lo:hi].reshape(-1, 4) if whole else None))
    return out
