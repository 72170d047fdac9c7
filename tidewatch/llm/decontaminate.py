"""Documents that hold benchmark items, up to a share of edits, by counting shared grams around a diagonal.

Texts are words without white space and outer punctuation, A-Z lower-cased. Each gram (a few characters in a row) of an
item that stands in a text too is a hit at a place of the text and one of the item; their difference is the hit's diagonal.
An edit removes the grams it touches only and moves the diagonal by one at most, so a text that holds an item has many hits
in a narrow band, wherever the edits stand. Bands with enough hits are candidates; they are confirmed by the exact edit
distance in characters between the item and the best part of the text around the band.

All places of items and texts count. Short items ask for as many hits as no edits can remove, so none is missed. Longer ones
have longer grams and ask for a third of the hits that edits at random places leave on average (see `asked`).
Items are broadcast in blocks of bounded size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, texts, words_of

#: Characters of a gram at most, of one that edits at random places should leave at least, and hits to ask for in that case.
GRAM, LEAST_GRAM, LEAST_HITS = 6, 5, 6
#: Highest edit distance as a share of an item's characters.
MAX_EDITS = 0.2
#: Characters of benchmark text that are broadcast at once.
BLOCK_CHARS = 16_000_000
#: Items whose hits are counted together, characters of text that they are counted in at least, and hits at once.
GROUP, PIECE, HITS = 256, 2**16, 2_000_000
#: Characters of documents that are searched together.
TOGETHER = 1_000_000
#: Pairs, and pairs times characters, whose edit distances are found in step; entries of a table of all items and letters.
LANES, CELLS = 2048, 2_000_000
#: Characters of candidates that a task holds before it measures them.
HELD_CHARS = 32_000_000
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = b" \t\n\r\x0b\x0c"
_MARK, _SPACE = 1, 2
_KINDS = bytes(_MARK if c in _EDGES else _SPACE if c in _SPACES else 0 for c in range(256))
#: Stands in no UTF-8 text.
_BREAK = b"\xff"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NEVER = 2**62


def tokens_of(text: bytes) -> list[bytes]:
    return [w for word in words_of(text) if (w := word.strip(_EDGES))]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def normals(texts: list[bytes]) -> list[bytes]:
    """The tokens of each text joined by spaces: what stands between two words is one run of marks and white space."""
    if not texts:
        return []
    whole = b"\n" + (b"\n" + _BREAK + b"\n").join(texts).lower() + b"\n"
    out, kinds = np.frombuffer(whole, np.uint8).copy(), np.frombuffer(whole.translate(_KINDS), np.uint8)
    kept = kinds == 0
    turns = np.flatnonzero(kept[1:] != kept[:-1]) + 1  # a run begins and one ends the whole
    starts, ends = np.append(0, turns[1::2]), np.append(turns[::2], len(kept))
    spaced = np.maximum.reduceat(kinds, starts) == _SPACE
    kept[starts[spaced]], out[starts[spaced]] = True, ord(" ")
    kept[_ranges(starts[~spaced], (ends - starts)[~spaced])] = True
    parts = out[kept].tobytes().split(_BREAK)
    if len(parts) != len(texts):
        raise ValueError("a text is not UTF-8")
    return [part[1:-1] for part in parts]


def normal(text: bytes) -> bytes:
    return normals([text])[0]


@lru_cache(maxsize=65536)
def asked(length: int, edits: int) -> tuple[int, int]:
    """(characters of a gram, hits to ask for) of an item of that length with so many edits at most.

    The longest gram of which edits at random places leave enough on average; a third of that is asked for. If there is
    none, the longest of which any edits leave one, and what they leave at least.
    """
    for gram in range(GRAM, LEAST_GRAM - 1, -1):
        if length - gram >= edits > 0:
            left = lgamma(length - gram + 1) + lgamma(length - edits + 1) - lgamma(length - gram - edits + 1) - lgamma(length + 1)
            hits = int((length - gram + 1) * np.exp(left) / 3)
            if hits >= LEAST_HITS:
                return gram, hits
    for gram in range(min(GRAM, length), 1, -1):
        if length - gram + 1 - gram * edits >= 1:
            return gram, length - gram + 1 - gram * edits
    return 1, max(0, length - edits)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram at each place that has one."""
    count = max(0, len(codes) - gram + 1)
    out = np.zeros(count, np.uint64)
    for i in range(gram):
        out += codes[i : i + count]
        out *= _ODD
    out ^= out >> np.uint64(29)
    out *= _ODD
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order; by sorting, which is quicker here than the hash table of np.unique."""
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


class Group:
    """Some items with grams of one size: where each gram stands in them."""

    def __init__(self, gram: int, items: list[tuple[int, np.ndarray, int, int]]):
        """items: (index, codes, edits, hits to ask for)."""
        self.gram, self.index = gram, np.array([i for i, *_ in items])
        self.lengths, self.edits, self.hits = (np.array(x, np.int64) for x in zip(*((len(c), e, h) for _, c, e, h in items), strict=True))
        # A band is as wide as two cells, and a cell wider than the edits can move the diagonal.
        self.shifts = np.array([int(e).bit_length() for e in self.edits], np.int64)
        self.longest, self.overlap = int(self.lengths.max()), int((self.lengths + self.edits).max())
        keys = np.concatenate([_grams(c, gram) for _, c, _, _ in items])
        self.bits = np.uint64(64 - min(24, max(8, len(keys).bit_length() + 4)))
        # Grams of the same slot count as equal: that adds hits and takes none.
        slots = (keys >> self.bits).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        filled = np.bincount(slots, minlength=2 ** (64 - int(self.bits)))
        self.first = np.append(0, np.cumsum(filled)).astype(np.int32)
        self.filled = np.packbits(filled > 0, bitorder="little")  # of a size that caches hold
        counts = np.maximum(0, self.lengths - gram + 1)
        self.owners = np.repeat(np.arange(len(items)), counts)[order]
        self.places = np.concatenate([np.arange(n) for n in counts])[order]
        self.moved_by = self.shifts[self.owners]

    def _hits(self, at: np.ndarray, first: np.ndarray, counts: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cell, posting) of the hits of the places `at`, which have counts of postings from first on, some at a time.

        base: by posting, the first place of its item's cells, less the posting's place.
        """
        ends, low = np.cumsum(counts), 0
        while low < len(at):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + HITS, "right")))
            n = counts[low:high]
            posting = _ranges(first[low:high], n)
            cell = np.repeat(at[low:high], n)
            cell += base[posting]
            cell >>= self.moved_by[posting]
            yield cell, posting
            low = high

    def bands(self, grams: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of parts of a text of size characters, with these grams, that may hold an item."""
        step, span = max(PIECE, 4 * self.overlap), -1
        for start in range(0, max(1, size - self.overlap), step):
            piece = grams[start : start + step + self.overlap]
            if span != (span := min(size - start, step + self.overlap)):
                cells = ((span + self.longest) >> self.shifts) + 3
                base = np.append(0, np.cumsum(cells))
                own = (base[self.owners] << self.moved_by) + self.longest - self.places
                needed = np.repeat(self.hits, cells)
                needed[base[1:] - 1] = _NEVER
            slots = (piece >> self.bits).view(np.int64)
            at = np.flatnonzero(self.filled[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
            slots = slots[at]
            first = self.first[slots].astype(np.int64)
            counts = self.first[slots + 1] - first
            found, total = np.zeros(int(base[-1]), np.int64), int(counts.sum())
            known = []
            for cell, posting in self._hits(at, first, counts, own):
                if len(cell) == total:
                    known, found = [(cell, posting)], np.bincount(cell, minlength=len(found))
                else:
                    found += np.bincount(cell, minlength=len(found))
            passed = np.zeros(len(found), bool)  # not the last one
            np.greater_equal(found[:-1] + found[1:], needed[:-1], out=passed[:-1])
            touched = passed.copy()
            touched[1:] |= passed[:-1]
            # A gram that text or item repeats makes many hits: of the bands left, count the item's places that are hit.
            keys = [np.zeros(0, np.int64)]
            for cell, posting in known or self._hits(at, first, counts, own):
                near = np.flatnonzero(touched[cell])
                cell, places = cell[near], self.places[posting[near]]
                own_band, band_before = passed[cell], passed[cell - 1]
                keys.append(_distinct(np.concatenate([cell[own_band] * self.longest + places[own_band], (cell[band_before] - 1) * self.longest + places[band_before]])))
            hit = (keys[1] if len(keys) == 2 else _distinct(np.concatenate(keys))) // self.longest
            firsts = np.flatnonzero(np.diff(hit, prepend=-1))
            hit, places = hit[firsts], np.diff(firsts, append=len(hit))
            enough = hit[places >= needed[hit]]
            passed = enough if self.hits.all() else np.union1d(enough, np.flatnonzero(passed & (needed == 0)))
            if not len(passed):
                continue
            breaks = np.flatnonzero(np.diff(passed) > 1)
            firsts, lasts = passed[np.append(0, breaks + 1)], passed[np.append(breaks, len(passed) - 1)]
            item = np.searchsorted(base, firsts, "right") - 1
            edits, shift = self.edits[item], self.shifts[item]
            begin = start - self.longest + ((firsts - base[item]) << shift) - edits
            end = start - self.longest + ((lasts + 2 - base[item]) << shift) + self.lengths[item] + 2 * edits
            yield from zip(self.index[item].tolist(), begin.tolist(), end.tolist(), strict=True)


def distance_within(item: str, text: str) -> tuple[int, int]:
    """(edits, end) of the part of text that is nearest to item: Levenshtein distance, bit-parallel over the item."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    up, down, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        equal = where.get(c, 0)
        vertical = equal | down
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (~(across | up) & mask), up & across
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = minus | (~(vertical | plus) & mask), plus & vertical
        if score < best:
            best, end = score, j
    return best, end


def _lanes(pairs: list[tuple[str, str]], blocks: int, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, masks): for each character of all texts, the row of masks that holds its places in the lane's item.

    last: an item's last character has the highest bit, and the bits below its first are set.
    """
    numbers: dict[str, int] = {}
    own = np.array([numbers.setdefault(item, len(numbers)) for item, _ in pairs], np.int64)
    sizes, lengths = np.array([len(item) for item in numbers]), np.array([len(text) for _, text in pairs])
    item_codes, text_codes = (np.frombuffer("".join(x).encode("utf-32-le"), np.uint32) for x in (numbers, (text for _, text in pairs)))
    letters = np.unique(item_codes)
    ranks = np.zeros(int(letters[-1]) + 2, np.int64)  # 0: of no item
    ranks[letters] = np.arange(1, len(letters) + 1)
    ranks = ranks.take(np.minimum(item_codes, len(ranks) - 1)), ranks.take(np.minimum(text_codes, len(ranks) - 1))
    # An item has a row for no letter of its own, which is that of what follows a shorter text too: it lowers no distance.
    none = np.arange(len(numbers)) * (len(letters) + 1)
    keys, wanted = np.repeat(none, sizes) + ranks[0], np.repeat(none[own], lengths) + ranks[1]
    count = len(numbers) * (len(letters) + 1)
    if count * blocks > CELLS:  # many items of large alphabets: rows of their own letters only
        present = np.unique(np.append(none, keys))
        at = np.minimum(np.searchsorted(present, wanted), len(present) - 1)
        wanted = np.where(present[at] == wanted, at, np.searchsorted(present, np.repeat(none[own], lengths)))
        none, keys, count = np.searchsorted(present, none), np.searchsorted(present, keys), len(present)
    unused = 64 * blocks - sizes if last else np.zeros(len(sizes), np.int64)
    masks = np.zeros((count, blocks), np.uint64)
    if last:
        masks[:, 0] = np.repeat((np.uint64(1) << unused.astype(np.uint64)) - np.uint64(1), np.diff(none, append=count))
    at = _ranges(unused, sizes)
    np.bitwise_or.at(masks, (keys, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    rows = np.repeat(none[own], lengths.max()).reshape(len(pairs), -1)
    rows[np.arange(rows.shape[1]) < lengths[:, None]] = wanted
    return np.ascontiguousarray(rows.T), masks


def _together(pairs: list[tuple[str, str]], blocks: int) -> np.ndarray:
    """The same distance for pairs whose items have as many blocks of 64 characters, one character of all texts at a time."""
    lengths, lanes = np.array([len(item) for item, _ in pairs], np.int64), len(pairs)
    rows, masks = _lanes(pairs, blocks)
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full((blocks, lanes), ~np.uint64(0)), np.zeros((blocks, lanes), np.uint64)
    score, best, end = lengths.copy(), lengths.copy(), ((lengths - 1) & 63).astype(np.uint64)
    for row in rows:
        found = masks[row]
        rises = falls = np.zeros(lanes, np.uint64)
        for block in range(blocks):
            equal, above, below = found[:, block], up[block], down[block]
            vertical, equal = equal | below, equal | falls
            across = (((equal & above) + above) ^ above) | equal
            plus, minus = below | ~(across | above), above & across
            if block == blocks - 1:
                score += ((plus >> end) & one).view(np.int64) - ((minus >> end) & one).view(np.int64)
            higher, lower = (plus << one) | rises, (minus << one) | falls
            rises, falls = plus >> top, minus >> top
            up[block], down[block] = lower | ~(vertical | higher), higher & vertical
        np.minimum(best, score, out=best)
    return best


def _single(pairs: list[tuple[str, str]]) -> np.ndarray:
    """The same for items of one block."""
    rows, masks = _lanes(pairs, 1, last=True)
    masks, one, top = masks[:, 0], np.uint64(1), np.int64(63)
    score = np.array([len(item) for item, _ in pairs], np.int64)
    best, down = score.copy(), np.zeros(len(pairs), np.uint64)
    up = np.array([(2**64 - 1) ^ ((1 << 64 - len(item)) - 1) for item, _ in pairs], np.uint64)
    equal, vertical, across, plus = (np.empty(len(pairs), np.uint64) for _ in range(4))
    change, signed = np.empty(len(pairs), np.int64), plus.view(np.int64)
    for row in rows:
        np.take(masks, row, out=equal, mode="clip")
        np.bitwise_or(equal, down, out=vertical)
        np.bitwise_and(equal, up, out=across)
        across += up
        across ^= up
        across |= equal
        np.bitwise_or(across, up, out=plus)
        np.invert(plus, out=plus)
        plus |= down
        across &= up  # what falls from here on
        score -= np.right_shift(signed, top, out=change)
        score += np.right_shift(across.view(np.int64), top, out=change)
        np.minimum(best, score, out=best)
        np.left_shift(plus, one, out=plus)
        np.left_shift(across, one, out=across)
        np.bitwise_or(vertical, plus, out=up)
        np.invert(up, out=up)
        up |= across
        np.bitwise_and(plus, vertical, out=down)
    return best


def distances_within(pairs: list[tuple[str, str]]) -> list[int]:
    """The edits of distance_within for many pairs: in lanes where enough items are of a size, else one by one."""
    out = [0] * len(pairs)
    order = sorted((-(-len(item) // 64), len(text), i) for i, (item, text) in enumerate(pairs))
    at = 0
    while at < len(order):
        blocks, end = order[at][0], at
        while end < len(order) and order[end][0] == blocks and end - at < LANES and (end - at + 1) * order[end][1] <= CELLS:
            end += 1
        part = [i for _, _, i in order[at : max(end, at + 1)]]
        if len(part) < 12 * blocks:
            found = [distance_within(*pairs[i])[0] for i in part]
        else:
            some = [pairs[i] for i in part]
            found = (_single(some) if blocks == 1 else _together(some, blocks)).tolist()
        for i, edits in zip(part, found, strict=True):
            out[i] = edits
        at += len(part)
    return out


def possible(pairs: list[tuple[str, str]], max_edits: float) -> list[tuple[str, str]]:
    """Those pairs whose distance may be within max_edits of the item's characters.

    An item's distance is no less than the sum of those of its pieces of 64 characters, each in the part of the text that
    it can reach: before and after it stand the other pieces, longer or shorter by the edits at most.
    """
    out = [pair for pair in pairs if len(pair[0]) <= 64]
    left = [(item, text, int(max_edits * len(item)), 0) for item, text in pairs if len(item) > 64]
    first = 0
    while left:
        parts = [(item[first : first + 64], text[max(0, first - edits) : max(0, len(text) - max(0, len(item) - first - 64) + edits)]) for item, text, edits, _ in left]
        least = [(*pair[:3], pair[3] + distance) for pair, distance in zip(left, distances_within(parts), strict=True)]
        first += 64
        out += [(item, text) for item, text, edits, low in least if low <= edits and len(item) <= first]
        left = [pair for pair in least if pair[3] <= pair[2] and len(pair[0]) > first]
    return out


@dataclass
class Items:
    """A block of benchmark items with their grams."""

    texts: list[str] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    groups: list[Group] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple[int, bytes]], max_edits: float = MAX_EDITS) -> Items:
        out, by_gram = Items(), defaultdict(list)
        for number, text in rows:
            if words := normal(text):
                out.ids.append(number)
                out.texts.append(words.decode())
        for index in sorted(range(len(out.ids)), key=lambda i: len(out.texts[i])):
            item = out.texts[index]
            edits = int(max_edits * len(item))
            gram, hits = asked(len(item), edits)
            by_gram[gram].append((index, _codes(item), edits, hits))
        out.groups = [Group(gram, own[i : i + GROUP]) for gram, own in sorted(by_gram.items()) for i in range(0, len(own), GROUP)]
        return out

    def candidates(self, plain: list[str]) -> dict[int, set[tuple[int, int, int]]]:
        """Text -> (item, start, end) of its parts that may hold an item. plain: normalised texts."""
        # No item holds a line feed, so no gram reaches from one text into the next.
        codes = _codes("\n".join(plain))
        ends = list(accumulate(len(text) + 1 for text in plain))
        out: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        grams: dict[int, np.ndarray] = {}
        for group in self.groups:
            if group.gram not in grams:
                grams = {group.gram: _grams(codes, group.gram)}
            for index, begin, end in group.bands(grams[group.gram], len(codes)):
                own = bisect_right(ends, max(begin, 0))
                while own < len(plain) and (low := ends[own] - len(plain[own]) - 1) < end:
                    if plain[own] and low + len(plain[own]) > begin:
                        out[own].add((index, max(0, begin - low), min(len(plain[own]), end - low)))
                    own += 1
        return out

    def confirmed(self, plain: list[str], tried: dict[int, set[tuple[int, int, int]]], max_edits: float) -> dict[int, dict[int | None, int]]:
        """Text -> item -> least edit distance, of the candidates that the text does hold."""
        out: dict[int, dict[int | None, int]] = {own: {} for own in tried}
        left: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
        size = 0

        def measure() -> None:
            pairs = possible(list(left), max_edits)
            for (item, around), edits in zip(pairs, distances_within(pairs), strict=True):
                if edits <= int(max_edits * len(item)):
                    for own, number in left[item, around]:
                        out[own][number] = min(edits, out[own].get(number, edits))
            left.clear()

        for own, candidates in tried.items():
            for index, begin, end in sorted(candidates):
                item, number = self.texts[index], self.ids[index]
                if out[own].get(number) == 0:
                    continue
                around = plain[own][begin:end]
                if item in around:
                    out[own][number] = 0
                else:
                    left[item, around].append((own, number))
                    size += len(item) + len(around)
                    if size > HELD_CHARS:
                        measure()
                        size = 0
        measure()
        return out


def _together_by_size(plain: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts): some texts in a row, of a bounded size together but for the last one."""
    first, size = 0, 0
    for i, text in enumerate(plain, 1):
        size += len(text)
        if size >= TOGETHER or i == len(plain):
            yield first, plain[first:i]
            first, size = i, 0


def _checked(batches: Iterator[pa.RecordBatch], items: object, max_edits: float) -> Iterator[pa.RecordBatch]:
    block = items.value
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
    for batch, documents in texts(batches, "text"):
        plain = [text.decode() for text in normals(documents)]
        tried: dict[int, set[tuple[int, int, int]]] = {}
        if block.ids:
            for first, part in _together_by_size(plain):
                tried |= {first + j: found for j, found in block.candidates(part).items()}
        held = block.confirmed(plain, tried, max_edits)
        rows = [[{"item_id": k, "edits": v} for k, v in sorted(held.get(j, {}).items(), key=lambda x: (x[0] is None, x[0] or 0))] for j in range(len(documents))]
        old = batch.column("items").to_pylist() if "items" in batch.schema.names else [[]] * len(rows)
        names = [n for n in batch.schema.names if n != "items"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array([a + b for a, b in zip(old, rows, strict=True)], kind)], [*names, "items"])


def find_items(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    max_edits: float = MAX_EDITS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs with items added: an array of (item_id, edits) of the benchmark items that a row's text holds.

    An item is held if the edit distance between its normalised text and some part of the row's is at most max_edits of
    its characters. Null, empty and punctuation-only items are held by nothing; null and empty texts hold nothing. Items
    with a null id are checked and reported as null. Repeated rows each get their own answer. Empty tables are allowed on
    either side. A column of docs named items is replaced.
    """
    spark = docs.sparkSession
    rows = keyed(benchmark, item_col, item_text_col)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // block_chars
    others = [c for c in docs.columns if c not in (text_col, "items")]
    out = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).where("text is not null").orderBy("id", "text").collect()
        items = spark.sparkContext.broadcast(Items.of([(r.id, r.text.encode()) for r in part], max_edits))
        out = out.mapInArrow(lambda it, items=items: _checked(it, items, max_edits), schema + ", items array<struct<item_id: bigint, edits: bigint>>")
    back = {text_col: F.col("text")} | {c: F.col(f"_{i}") for i, c in enumerate(others)}
    return out.select(*(back[c].alias(c) for c in docs.columns if c in back), "items")
