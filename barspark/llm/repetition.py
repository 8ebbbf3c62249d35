"""Quality rules from a suffix array: how much of a text repeats, and the longest stretch that does.

The suffix array is over words. Suffixes of all texts in a slice are sorted together by prefix doubling, with ranks
that keep texts apart, so that only suffixes of one text share prefixes; a suffix leaves the doubling once its
rank is its own. A maximal repeated substring is an interval of the longest-common-prefix array: its suffixes share a prefix
that no wider interval shares (so it cannot go on to the right), and not all of them have the same word before (so it cannot to the left).
The spans of all these repeats are united for the covered fraction: at each suffix the deepest interval around it has
the longest span, so one span a suffix gives the union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barspark.llm.storage import documents
from barspark.llm.textbytes import slices, span_hashes, window_hashes, word_bounds

#: Fixed values of the base rules.
BASE_SYMBOLS = b"#*$%&|<>"
BASE_WINDOW, BASE_LEAST_WORDS, BASE_REPEAT_PERCENT = 8, 20, 30
#: The verdict: repeats of MIN_REPEAT words or more count; they may cover MAX_COVERED of the words, and the longest may
#: have MAX_LONGEST words.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 3, 0.30, 40

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(BASE_SYMBOLS)] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, covered_words long, covered_fraction double, longest_repeat long, n_maximal long"
)


def common_prefixes(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the words that each suffix but the last shares with the next one; nothing is shared across texts.

    words are hashes or numbers, text their nondecreasing text numbers.
    """
    n = len(words)
    if n < 2:
        return np.arange(n), np.zeros(max(0, n - 1), np.int64)
    values, codes = np.unique(words, return_inverse=True)
    key = text.astype(np.uint64) * np.uint64(len(values)) + codes.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    # rank: number of the first suffix with an equal prefix, so ranks stay right while others are refined.
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    history, k = [rank.copy()], 1
    alone = np.concatenate((fresh, [True]))
    active = order[~(alone[:-1] & alone[1:])]
    suffix_at = order.copy()
    while len(active):
        after = np.minimum(active + k, n)
        # A suffix that ends, or runs into the next text, comes before all that go on.
        same_text = (after < n) & (text[np.minimum(after, n - 1)] == text[active])
        second = np.where(same_text, rank[after], -1) + 1
        pair = rank[active].astype(np.uint64) * np.uint64(n + 2) + second.astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        group = rank[active]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        first_at = np.maximum.accumulate(np.where(new_group, np.arange(len(active)), 0))
        place = group + np.arange(len(active)) - first_at
        suffix_at[place] = active
        new_pair = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank = rank.copy()
        rank[active] = np.maximum.accumulate(np.where(new_pair, place, 0))
        history.append(rank)
        k *= 2
        edge = np.concatenate((new_pair, [True]))
        active = active[~(edge[:-1] & edge[1:])]
    # Common prefixes of neighbours: jump by falling powers of two while the ranks agree.
    left, right = suffix_at[:-1].copy(), suffix_at[1:].copy()
    pairs = np.flatnonzero(history[0][left] == history[0][right])
    left, right = left[pairs], right[pairs]
    common = np.zeros(len(pairs), np.int64)
    at_left, at_right = left.copy(), right.copy()
    for level in range(len(history) - 1, -1, -1):
        r, step = history[level], 1 << level
        inside = (at_left < n) & (at_right < n)
        a, b = np.minimum(at_left, n - 1), np.minimum(at_right, n - 1)
        ok = inside & (r[a] == r[b]) & (text[a] == text[left]) & (text[b] == text[left])
        common += ok * step
        at_left, at_right = at_left + ok * step, at_right + ok * step
    shared = np.zeros(n - 1, np.int64)
    shared[pairs] = common
    return suffix_at, shared


def longest_repeats(suffixes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each word the length of the longest stretch from it that occurs elsewhere in its text (may overlap)."""
    longest = np.zeros(len(suffixes), np.int64)
    np.maximum.at(longest, suffixes[:-1], shared)
    np.maximum.at(longest, suffixes[1:], shared)
    return longest


def intervals(shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last suffix of each interval whose suffixes share least words or more, and how many; nested ones too.

    One pass with a stack over the places that share so many: an interval ends where fewer words are shared.
    """
    out: list[tuple[int, int, int]] = []
    places = np.flatnonzero(shared >= least)
    open_: list[tuple[int, int]] = []  # (first suffix, words), rising
    before = -2
    for k, words in zip(places.tolist(), shared[places].tolist(), strict=True):
        if k != before + 1:
            out += [(first, before + 1, n) for first, n in open_]
            open_ = []
        first = k
        while open_ and open_[-1][1] > words:
            first, n = open_.pop()
            out.append((first, k, n))
        if not open_ or open_[-1][1] < words:
            open_.append((first, words))
        before = k
    out += [(first, before + 1, n) for first, n in open_]
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def maximal_repeats(words: np.ndarray, text: np.ndarray, suffixes: np.ndarray, shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of each maximal repeat of least words or more, and its text number.

    Of an interval's suffixes two must differ in the word before; the start of a text is a word of its own.
    """
    first, last, length = intervals(shared, least)
    if not len(first):
        return length, length
    opens = np.concatenate(([True], text[1:] != text[:-1]))
    before = np.where(opens, np.uint64(0), np.concatenate((words[:1], words[:-1])))[suffixes]
    start = opens[suffixes]
    # Two starts of texts cannot be in one interval, so a start differs from all others.
    changes = np.concatenate(([0], np.cumsum((before[1:] != before[:-1]) | start[1:] | start[:-1])))
    kept = changes[last] > changes[first]
    return length[kept], text[suffixes[first[kept]]]




def covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover, together."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_in_windows(words: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of size words that its text has twice or more."""
    hashes, at = window_hashes(words ^ (text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), text, size)
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    hit = at[np.isin(hashes, twice)] if len(twice) else at[:0]
    return covered(hit, np.full(len(hit), size), len(words))


def duplicate_lines(buf: np.ndarray, off: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """For each text the number of lines with a word that equal an earlier line. Lines end at \\n only."""
    n_texts = len(off) - 1
    out = np.zeros(n_texts, np.int64)
    breaks = np.flatnonzero(buf == 10)
    if not len(breaks):
        return out
    starts = np.sort(np.concatenate((off[:-1], breaks + 1)))
    starts = np.unique(starts[starts < len(buf)])
    text = np.searchsorted(off, starts, "right") - 1
    following = np.concatenate((starts[1:], [len(buf)]))
    broken = buf[following - 1] == 10
    ends = np.minimum(np.where(broken, following - 1, following), off[text + 1])
    has_word = np.searchsorted(word_start, ends) > np.searchsorted(word_start, starts)
    starts, ends, text = starts[has_word], ends[has_word], text[has_word]
    if not len(starts):
        return out
    h = span_hashes(buf, starts, ends) ^ (text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.lexsort((h, text))
    again = np.concatenate(([False], (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])))
    np.add.at(out, text[order][again], 1)
    return out


def _per_text(flags: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=flags, minlength=n).astype(np.int64)


def measured(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first row, last row + 1, columns) of the rules, for slices of a column of texts."""
    for low, high, buf, off in slices(column):
        n = high - low
        start, end, text = word_bounds(buf, off)
        words = span_hashes(buf, start, end)
        # Continuation bytes are no code points of their own, and spaces are all ASCII.
        leads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        symbols = np.concatenate(([0], np.cumsum(IS_SYMBOL[buf])))
        n_words = np.bincount(text, minlength=n)
        n_repeat = _per_text(repeated_in_windows(words, text, BASE_WINDOW), text, n)
        failed = (n_words < BASE_LEAST_WORDS) | (100 * n_repeat > BASE_REPEAT_PERCENT * n_words)
        suffixes, shared = common_prefixes(words, text)
        longest = longest_repeats(suffixes, shared)
        counted = np.flatnonzero(longest >= MIN_REPEAT)
        n_covered = _per_text(covered(counted, longest[counted], len(words)), text, n)
        lengths, of = maximal_repeats(words, text, suffixes, shared, MIN_REPEAT)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, of, lengths)
        fraction = n_covered / np.maximum(n_words, 1)
        yield low, high, {
            "n_words": n_words,
            "word_chars": _per_text(leads[end] - leads[start], text, n),
            "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
            "n_dup_lines": duplicate_lines(buf, off, start),
            "n_repeat_words": n_repeat,
            "base_failed": failed,
            "kept": ~failed & (fraction <= MAX_COVERED) & (most <= MAX_LONGEST),
            "covered_words": n_covered,
            "covered_fraction": fraction,
            "longest_repeat": most,
            "n_maximal": np.bincount(of, minlength=n).astype(np.int64),
        }


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for low, high, columns in measured(batch.column("text")):
            yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *map(pa.array, columns.values())], ["doc_id", *columns])


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts, base_failed, kept and the suffix array's measures.

    longest_repeat is the length of the longest maximal repeat, 0 if none has MIN_REPEAT words; n_maximal is their number; kept asks that
    their spans cover at most MAX_COVERED of the words and that the longest has at most MAX_LONGEST. A null or empty text has no words,
    fails the base rule (fewer than 20 words) and is not kept. Repeated rows give repeated results; an empty table gives none; other columns are ignored. There is no shuffle, and a lost
    executor costs its own tasks only.
    """
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_rules, SCHEMA)


def op7_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repetition_rules() of all documents."""
    return repetition_rules(documents(spark, sf_dir))
