"""Benchmark passages in documents, found by windows of canonical templates and checked for consistent slots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import in_small_batches, mix64, worker_cache, written

#: Units of measure and currency that a template holds as <unit>.
UNITS = frozenset(
    "mm cm m km millimeter millimeters centimeter centimeters meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces pound pounds lb lbs oz ml cl l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years degree degrees celsius fahrenheit kelvin watt watts volt volts joule joules "
    "percent dollar dollars euro euros cent cents yen rupee rupees mph kph hz khz mhz ghz kb mb gb tb".split()
)
#: Numbers spelled out. "one" is left out: it mostly stands for something else.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
_TOKENS = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?]")
#: The same for texts of Latin letters alone: a set of characters is looked up faster than a class of them.
_LATIN = "".join(chr(c) for c in range(0x250) if re.fullmatch(r"[^\W\d_]", chr(c)))
_LATIN_TOKENS = re.compile(rf"[{_LATIN}]+|[0-9]+(?:[.,:/][0-9]+)*|[.!?]")
#: Scripts written without blanks between words, where each letter is a token: Thai and Lao, Burmese, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED_TOKENS = re.compile(rf"(?=[{_UNSPACED}])[^\W\d_]|[^\W\d_{_UNSPACED}]+|\d+(?:[.,:/]\d+)*|[.!?]")
#: Entries of a worker's table of token classes; it is emptied when full.
_CLASSES = 400_000
_STOP, _NUMBER, _UNIT, _CAPITAL, _WORD, _UPPER = range(6)
_KINDS = {_NUMBER: "num", _UNIT: "unit", _CAPITAL: "name"}
_FIXED = dict.fromkeys(".!?", _STOP) | dict.fromkeys(UNITS, _UNIT) | dict.fromkeys(NUMBER_WORDS, _NUMBER)
#: The hash of a slot by its class.
_PLACEHOLDERS = mix64(np.arange(1, 7, dtype=np.uint64))
#: A factor of the hashes of windows; any odd number of 64 bits would do.
_BASE = 0x9E3779B97F4A7C15
#: What a hash stands for: a window anywhere, a whole text, a passage without one token.
_PART, _WHOLE, _GAP = 0, 1, 2


@dataclass(frozen=True)
class DecontaminationConfig:
    """window: tokens of a window; a shorter item is one window of its own length. least_tokens: an item with fewer is
    found inside a text only verbatim, and if least_inside of its tokens aren't numbers. least_words: tokens of a window that must be words and not placeholders, as
    windows of numbers alone say nothing. least_share: share of an item that a passage must hold. least_run: tokens of an
    unbroken run that counts whatever its share of the item. drift: tokens by which a change may move a passage on.
    filter_bits: log2 of the size of each of the two filters that are sent to every task, whatever the size of the benchmark.
    """

    window: int = 8
    least_tokens: int = 5
    least_inside: int = 2
    least_words: int = 4
    least_share: float = 0.5
    least_run: int = 13
    drift: int = 8
    filter_bits: int = 23

    def seed(self, length: int) -> int:
        """Width of the first and last tokens of an item of a length, of which one keeps whole when a token is replaced; 0 where
        the windows find such an item anyway."""
        return min(self.window, length // 2) if self.window < length < self.window + self.least_run else 0


class _Classes(dict):
    """token -> hash of its lower case with its class in the lowest three bits, remembered for frequent tokens."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = _FIXED.get(low)
        if kind is None:
            if token[0].isdecimal():
                kind = _NUMBER
            elif len(token) == 1 or token.islower():
                kind = _WORD
            elif token[0].isupper() and token[1:].islower():
                kind = _CAPITAL
            else:
                kind = _UPPER if token.isupper() else _WORD
        if len(self) >= _CLASSES:
            self.clear()
        self[token] = value = (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~7) | kind
        return value


@cache
def _power(k: int) -> np.uint64:
    return np.uint64(pow(_BASE, k, 1 << 64))


class Rolling:
    """Hashes of all windows of a text's tokens, a polynomial of each; those of a width come from those of its parts."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.known = tokens, {1: tokens}

    def of(self, width: int) -> np.ndarray:
        """The hash of the window at each place; none in a shorter text."""
        if (n := len(self.tokens) - width + 1) <= 0:
            return np.zeros(0, np.uint64)
        if width not in self.known:
            left = 1 << (width - 1).bit_length() - 1
            out = self.of(left)[:n] * _power(width - left)
            out += self.of(width - left)[left : left + n]
            self.known[width] = out
        return self.known[width]

    def at(self, places: np.ndarray, width: int, gaps: np.ndarray | None = None) -> np.ndarray:
        """Of some places; gaps: a token of the window left out, for each of them (a column for each gap)."""
        total = np.zeros(len(places), np.uint64)
        for k in range(width):
            total = total * _power(1) + self.tokens[places + k]
        if gaps is None:
            return total
        weights = np.array([_power(width - 1 - g) for g in gaps.tolist()], np.uint64)
        return total[:, None] - self.tokens[places[:, None] + gaps] * weights


def _keys(hashes: np.ndarray, width: int, form: np.ndarray | int) -> np.ndarray:
    """The hashes that are joined. form: _PART, _WHOLE (of a text that is nothing else), or _GAP and the token left out."""
    salt = np.uint64(width << 16) + np.asarray(form).astype(np.uint64)
    return mix64(hashes + mix64(np.atleast_1d(salt))).view(np.int64)


@dataclass(frozen=True)
class Template:
    """Of a text: hashes of its tokens with placeholders and without, which tokens are slots (their class, else 0), and the tokens."""

    hashes: np.ndarray
    literal: np.ndarray
    kinds: np.ndarray
    capital: np.ndarray
    tokens: list[str]
    at: np.ndarray

    @cached_property
    def rolling(self) -> Rolling:
        return Rolling(self.hashes) if self.kinds.any() else self.own_rolling

    @cached_property
    def own_rolling(self) -> Rolling:
        return Rolling(self.literal)

    def with_slots(self, kinds: np.ndarray) -> Template:
        return replace(self, kinds=kinds, hashes=np.where(kinds > 0, _PLACEHOLDERS[kinds], self.literal))

    def named(self) -> Template:
        """Names as words, whether they are capitalised or not."""
        return self.with_slots(np.where(self.kinds == _CAPITAL, 0, self.kinds).astype(self.kinds.dtype))

    def turned(self, place: int) -> Template:
        """With one capitalised token read the other way: as a name, or as the first word of a sentence."""
        kinds = self.kinds.copy()
        kinds[place] = 0 if kinds[place] else _CAPITAL
        return self.with_slots(kinds)

    def slots(self, start: int, width: int, gap: int = -1) -> list[str]:
        """kind:value of each slot of a window, in order; gap: a place of the window that is left out."""
        places = start + np.flatnonzero(self.kinds[start : start + width])
        return [f"{_KINDS[int(self.kinds[p])]}:{self.tokens[self.at[p]].lower()}" for p in places if p != start + gap]


def canonical(text: str) -> Template:
    """Numbers, names and units become placeholders.

    A name is a capitalised word that doesn't begin a sentence, or one in capitals between others that aren't; the words
    of one name stay apart, so that a window keeps its length. A number may be spelled out; a unit is one of UNITS after a
    number. In scripts without blanks each letter is a token.
    """
    last = 0 if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max()
    tokens = (_LATIN_TOKENS if last < 0x250 else _TOKENS if last < 0xE00 else _UNSPACED_TOKENS).findall(text)
    packed = np.fromiter(map(worker_cache("template classes", _Classes).__getitem__, tokens), np.uint64, len(tokens))
    kind = (packed & np.uint64(7)).astype(np.int8)
    if (upper := kind == _UPPER).any():
        beside = np.concatenate((upper[1:], [False])) | np.concatenate(([False], upper[:-1]))
        kind = np.where(upper, np.where(beside, _WORD, _CAPITAL), kind).astype(np.int8)
    before = np.concatenate((np.zeros(1, np.int8), kind[:-1])) if len(kind) else kind  # a text begins like a sentence
    slot = np.where(kind == _NUMBER, kind, 0)
    slot = np.where((kind == _UNIT) & (before == _NUMBER), kind, slot)
    slot = np.where((kind == _CAPITAL) & (before != _STOP), kind, slot)
    at = np.flatnonzero(kind != _STOP)
    slot = slot[at]
    literal = packed[at] >> np.uint64(3)
    return Template(np.where(slot > 0, _PLACEHOLDERS[slot], literal), literal, slot, kind[at] == _CAPITAL, tokens, at)


def _counts(marked: np.ndarray, width: int) -> np.ndarray:
    """How many marked tokens each window of a width holds; none in a shorter text."""
    sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(marked)))
    return sums[width:] - sums[:-width]


def _mixed(template: Template, width: int) -> np.ndarray:
    """Places of the windows with both names and other slots: their names can be words while the rest are slots."""
    name = template.kinds == _CAPITAL
    if len(template.hashes) < width or not name.any() or not ((template.kinds > 0) & ~name).any():
        return np.zeros(0, np.int64)
    names = _counts(name, width)
    return np.flatnonzero((names > 0) & (_counts(template.kinds > 0, width) > names))


def _item_windows(template: Template, width: int, least_words: int) -> tuple[np.ndarray, list[tuple[int, int, bool, list[str]]]]:
    """(places that count, (place, hash, literal, slots) of each reading of a window, the more literal first)."""
    least = min(least_words, width)
    own = np.flatnonzero((_counts(template.kinds > 0, width) > 0) & (_counts(template.kinds != _NUMBER, width) >= least))
    main = at = np.flatnonzero(_counts(template.kinds == 0, width) >= least)
    if not len(main):
        main = own = np.arange(len(template.hashes) - width + 1)
    others = [(template, at), (template.named(), _mixed(template, width))]
    others += [(template.turned(k), np.array([k])) for k in np.flatnonzero(template.capital[: len(template.capital) - width + 1]).tolist()]
    out = [(k, h, True, template.slots(k, width)) for k, h in zip(own.tolist(), template.own_rolling.at(own, width).tolist())]
    for other, places in others:
        places = places[_counts(other.kinds == 0, width)[places] >= least]
        out += [(k, h, False, other.slots(k, width)) for k, h in zip(places.tolist(), other.rolling.at(places, width).tolist())]
    return main, list({(k, h): (k, h, own, slots) for k, h, own, slots in reversed(out)}.values())


def _gapped(template: Template, cfg: DecontaminationConfig) -> tuple[list[int], list[tuple[int, int, bool, list[str]]]]:
    """Of an item that a replaced token can hide: (hashes of its first and last tokens, (gap, hash, literal, slots) without each)."""
    length = len(template.hashes)
    if not (seed := cfg.seed(length)):
        return [], []
    start, gaps, ends, out = np.zeros(1, np.int64), np.arange(length), np.array([0, length - seed]), []
    others = [template, *([template.turned(0)] if template.capital[0] else [])]
    readings = [(template.own_rolling, template.kinds != _NUMBER, True, template)] + [(t.rolling, t.kinds == 0, False, t) for t in others]
    seeds = {h for rolling, *_ in readings for h in rolling.at(ends, seed).tolist()}
    for rolling, words, own, other in readings:
        enough = words.sum() - words >= cfg.least_words
        out += [(g, h, own, other.slots(0, length, g)) for g, h in zip(gaps.tolist(), rolling.at(start, length, gaps)[0].tolist()) if enough[g]]
    return list(seeds), list({(g, h): (g, h, own, slots) for g, h, own, slots in reversed(out)}.values())


def _benchmark_windows(benchmark: DataFrame, cfg: DecontaminationConfig, id_col: str, text_col: str) -> DataFrame:
    """(hash, bits, item_id, at, of, reach, length, width, gap, main, literal, slots): every reading of every window of every item.

    main: the window counts; these are those with a template, or all if none has. of, reach: their number, and their tokens.
    gap: the token left out of a whole item, or -1; at is then the number of windows that count beside it. bits: the highest
    of the hash before it was salted, by which a text is sifted; a row without a hash is a seed, only there for them.
    """
    shift = 64 - cfg.filter_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.bool_(), pa.list_(pa.string()))
        names = ["hash", "bits", "item_id", "at", "of", "reach", "length", "width", "gap", "main", "literal", "slots"]
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                template = canonical(text or "")
                length = len(template.hashes)
                if not (width := min(cfg.window, length)):
                    continue
                at, readings = _item_windows(template, width, cfg.least_words)
                main, reach = set(at.tolist()), len(np.unique(at[:, None] + np.arange(width)))

                def row(h: int, form: int, place: int, gap: int, wide: int, counts: bool, own: bool, slots: list[str]) -> tuple:
                    key = int(_keys(np.array([h], np.uint64), wide, form)[0])
                    return key, h >> shift, item, place, len(at), reach, length, width, gap, counts, own, slots

                form = _WHOLE if width < cfg.least_tokens else _PART
                rows += [row(h, form, k, -1, width, k in main, own, slots) for k, h, own, slots in readings]
                if form == _WHOLE and (template.kinds != _NUMBER).sum() >= cfg.least_inside:
                    h = int(template.own_rolling.of(width)[0])
                    rows.append(row(h, _PART, 0, -1, width, True, True, template.slots(0, width)))
                seeds, without = _gapped(template, cfg)
                rows += [(None, h >> shift, item, 0, len(at), reach, length, width, -1, False, True, []) for h in seeds]
                rows += [row(h, _GAP + g, int(((at > g) | (at + width <= g)).sum()), g, length, False, own, slots) for g, h, own, slots in without]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    return items.mapInArrow(run, "hash long, bits long, item_id long, at int, of int, reach int, length int, width int, gap int, main boolean, literal boolean, slots array<string>")


class _Sieve:
    """The windows of a text whose bits are set in a bitmap, of windows or of seeds."""

    def __init__(self, bitmaps: tuple[np.ndarray, np.ndarray], cfg: DecontaminationConfig, widths: list[int], lengths: list[int]):
        self.bitmaps, self.cfg, self.widths = bitmaps, cfg, widths
        self.seeds: dict[int, list[int]] = {}
        for length in lengths:
            if seed := cfg.seed(length):
                self.seeds.setdefault(seed, []).append(length)

    def passes(self, hashes: np.ndarray, seed: bool = False) -> np.ndarray:
        """Places of the hashes whose bit is set."""
        bits = hashes >> np.uint64(64 - self.cfg.filter_bits)
        return np.flatnonzero((self.bitmaps[seed][bits >> np.uint64(5)] >> (bits & np.uint64(31)).astype(np.uint32)) & np.uint32(1))

    def hits(self, template: Template, width: int, seed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of windows that pass as they stand; which of them hold a slot; and places of those that pass as templates.

        A window without a slot is its own template, so only those with one are hashed again.
        """
        own = self.passes(template.own_rolling.of(width), seed)
        if not template.kinds.any():
            return own, np.zeros(len(own), bool), own
        slots = _counts(template.kinds > 0, width) > 0
        slotted = np.flatnonzero(slots)
        at = slotted[self.passes(template.rolling.at(slotted, width), seed)]
        return own, slots[own], np.concatenate((own[~slots[own]], at))

    def found(self, template: Template) -> Iterator[tuple[int, int, list[str]]]:
        """(place, key, slots as they are read) of windows of a document: as templates, with names as words, as they stand."""
        length = len(template.hashes)
        for width in self.widths:
            if width > length:
                break
            own, slotted, at = self.hits(template, width)
            form = _PART
            if width < self.cfg.least_tokens:
                yield from self.read(own, template.own_rolling, width, _PART, None)
                if width < length:
                    continue
                form = _WHOLE
            if slotted.any():
                yield from self.read(own[slotted], template.own_rolling, width, form, None)
            if len(at):
                at = at[_counts(template.kinds == 0, width)[at] >= min(self.cfg.least_words, width)]
                yield from self.read(at, template.rolling, width, form, template)
            if len(mixed := _mixed(template, width)):
                named = template.named()
                yield from self.read(mixed[self.passes(named.rolling.at(mixed, width))], named.rolling, width, form, named)
        for seed, lengths in self.seeds.items():
            if seed > length:
                continue
            own, _, at = self.hits(template, seed, True)
            for size in lengths:
                if len(own):
                    yield from self.without(template.own_rolling, None, own, seed, size, length)
                if len(at) and template.kinds.any():
                    yield from self.without(template.rolling, template, at, seed, size, length)

    def read(self, places: np.ndarray, rolling: Rolling, width: int, form: int, reading: Template | None) -> Iterator[tuple[int, int, list[str]]]:
        keys = _keys(rolling.at(places, width), width, form)
        return ((k, h, reading.slots(k, width) if reading else []) for k, h in zip(places.tolist(), keys.tolist()))

    def without(self, rolling: Rolling, reading: Template | None, hit: np.ndarray, seed: int, size: int, length: int) -> Iterator[tuple[int, int, list[str]]]:
        """(place, key, slots) of passages of a size without one token, that begin or end with a seed."""
        for starts, gaps in ((hit, np.arange(seed, size)), (hit - (size - seed), np.arange(size - seed))):
            starts = starts[(starts >= 0) & (starts + size <= length)]
            if not len(starts):
                continue
            hashes = rolling.at(starts, size, gaps)
            row, column = np.divmod(self.passes(hashes.ravel()), len(gaps))
            keys = _keys(hashes[row, column], size, _GAP + gaps[column]) if len(row) else row
            for k, g, h in zip(starts[row].tolist(), gaps[column].tolist(), keys.tolist()):
                yield k, h, reading.slots(k, size, g) if reading else []


def text_key(text: F.Column) -> F.Column:
    """Two hashes of a text, of 96 bits together; null for a null text."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("hash"), F.hash(text).alias("check")))


def _filter(marks: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the bits of all marks, merged on Spark in words of 32 bits: 2**bits bits at most."""
    bit = marks.select(F.shiftright("bits", 5).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bits & 31L as int))").alias("bit"))
    words = bit.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().astype(np.uint32)
    return out


class _Hit:
    """A window of an item found in a text, as the last of a chain: each hit stands after the one before in both."""

    __slots__ = ("before", "here", "at", "pairs", "first", "windows", "covered", "run", "longest", "own_run", "own_longest", "last")

    def __init__(self, before: _Hit | None, here: int, at: int, width: int, main: bool, pairs: list[tuple[str, str]]):
        self.before, self.here, self.at, self.pairs, self.last = before, here, at, pairs, True
        own = all(ours == theirs for ours, theirs in pairs)
        if before is None:
            self.first, self.windows, self.covered, self.run, self.own_run = here - at, int(main), width, width, width * own
            self.longest, self.own_longest = self.run, self.own_run
            return
        before.last = False
        step = at - before.at
        joined = step <= width and here - before.here == step
        self.first, self.windows, self.covered = before.first, before.windows + main, before.covered + min(width, step)
        self.run = before.run + step if joined else width
        self.own_run = (before.own_run + step if joined and before.own_run else width) * own
        self.longest, self.own_longest = max(before.longest, self.run), max(before.own_longest, self.own_run)


def _agreed(hit: _Hit) -> tuple[bool, bool, bool]:
    """Of a chain's slots: whether each value of the item stands for one of the text, the other way round, and for itself."""
    forth: dict[str, str] = {}
    back: dict[str, str] = {}
    function = one_to_one = own = True
    while hit is not None:
        for ours, theirs in hit.pairs:
            function &= forth.setdefault(ours, theirs) == theirs
            one_to_one &= back.setdefault(theirs, ours) == ours
            own &= ours == theirs
        hit = hit.before
    return function, one_to_one, own


class _Chains:
    """Passages of one item in one text, from its hits by place in the text: straight ones, and ones that drift."""

    def __init__(self, cfg: DecontaminationConfig, of: int, reach: int, length: int, width: int):
        self.cfg, self.of, self.reach, self.length, self.width = cfg, of, reach, length, width
        self.open: tuple[dict[int, _Hit], dict[int, _Hit]] = ({}, {})
        self.best: tuple | None = None
        self.swept = 0

    def add(self, here: int, at: int, main: bool, pairs: list[tuple[str, str]]) -> None:
        if here - self.swept > 4 * self.length:
            self.sweep(here)
        for drift, chains in zip((0, self.cfg.drift), self.open):
            before, most = None, 0
            for shift in range(here - at - drift, here - at + drift + 1):
                hit = chains.get(shift)
                if hit is not None and hit.at < at and hit.here < here and here - hit.here <= self.length + drift:
                    gain = 2 * (hit.covered + min(self.width, at - hit.at)) + (shift == here - at)
                    if gain > most:
                        before, most = hit, gain
            old, chains[here - at] = chains.get(here - at), _Hit(before, here, at, self.width, main, pairs)
            self.end(old)

    def sweep(self, here: int) -> None:
        self.swept = here
        for chains in self.open:
            for shift in [s for s, hit in chains.items() if here - hit.here > self.length + self.cfg.drift]:
                self.end(chains.pop(shift))

    def end(self, hit: _Hit | None) -> None:
        if hit is None or not hit.last:
            return
        cfg = self.cfg
        enough = hit.windows >= max(1, self.of * cfg.least_share) or hit.covered >= max(cfg.least_run, self.reach * cfg.least_share) or hit.longest >= cfg.least_run
        quoted = hit.own_longest >= cfg.least_run
        if not (enough or quoted):
            return
        found = (hit.windows, -hit.first)
        if self.best is None or found > self.best[:2]:
            function, one_to_one, own = _agreed(hit)
            if function or quoted:
                self.best = (*found, own, one_to_one)

    def without_one(self, here: int, windows: int, pairs: list[tuple[str, str]]) -> None:
        """A copy of the whole item but for one token."""
        found = (windows, -here)
        if self.best is None or found > self.best[:2]:
            function, one_to_one, own = _agreed(_Hit(None, here, 0, self.length, False, pairs))
            if function:
                self.best = (*found, own, one_to_one)

    def passage(self) -> tuple | None:
        """(windows, -start, exact, one_to_one) of the passage with most windows, the first of several."""
        for chains in self.open:
            for hit in chains.values():
                self.end(hit)
        return self.best


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: DecontaminationConfig = DecontaminationConfig(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, windows, of, start, exact, one_to_one, text_key): each document that holds a passage of a benchmark item.

    Documents are read once. A window goes on to the join only if its bit is set in a bitmap of fixed size, which
    drops nearly all of a clean text and no match. Matches are joined on the hash and dealt by document and item. There
    they are chained: each stands after the one before, in the text and in the item, and a changed, added or missing
    word moves the rest by cfg.drift tokens at most. A chain counts if it holds least_share of the item's windows, or of
    its tokens and least_run of them, or a run of least_run tokens without a break, and if its slots agree: each value
    of the item always stands for one value of the document. one_to_one: and the other way round. A run of least_run tokens with
    the item's own values counts whatever stands around it. exact: all slots have the item's own values.

    Every window is also read literally, in lower case, and with names as words; and one of an item whose first token is
    capitalised with that as a name and as a word. So neither case nor what stands before a passage hides a copy. An item
    whose windows are all too poor in words is found by windows of its own tokens, so by verbatim copies.
    An item of window + 1 to window + least_run - 1 tokens, which a replaced token may leave without windows enough, is also
    looked for with each of its tokens left out: where its first or last tokens stand, the rest is tried. exact then speaks of
    the other tokens, and windows counts those beside the gap. A shorter item has to be whole, as does a window; an added or
    missing token still hides an item of fewer than 2 * window tokens.

    An item of numbers alone is found by its own numbers, from least_tokens of them; with fewer, or with fewer than
    least_inside other tokens if it is shorter than least_tokens, only as the whole of a text. In scripts without blanks each
    letter is a token.

    text_key is text_key(text) of the document's text, by which a caller whose ids may repeat or be null finds the row.

    Defined cases: null ids, null and empty texts match nothing; repeated rows of docs give one result, and an id with
    several texts one for the text with the longest passage; of equally long passages the first counts; several texts
    of one item_id are looked for one by one, unless their windows and lengths are equal in number; other columns are ignored;
    empty tables give no rows.
    """
    marks = written(_benchmark_windows(benchmark, cfg, item_col, item_text_col), "benchmark_windows")
    held = docs.sparkSession.sparkContext.broadcast(tuple(_filter(marks.where(F.col("hash").isNull() == seed), cfg.filter_bits) for seed in (False, True)))
    sizes = marks.select("width", F.when(F.col("gap") >= 0, F.col("length")).alias("length")).distinct().collect()  # few: both are bounded
    sieve = sorted({r.width for r in sizes}), sorted({r.length for r in sizes if r.length is not None})
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sift = _Sieve(held.value, cfg, *sieve)
        for batch in batches:
            for doc, text, *key in zip(*(c.to_pylist() for c in batch.columns)):
                if hit := list(sift.found(canonical(text or ""))):
                    here, found, mine = zip(*hit)
                    columns = ([doc] * len(hit), *([k] * len(hit) for k in key), here, found, mine)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "copy", "check", "here", "hash", "mine"])

    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    key = text_key(F.col("text"))  # an id may have several texts
    texts = in_small_batches(whole).select("doc_id", "text", key["hash"].alias("copy"), key["check"].alias("check"))
    hits = texts.mapInArrow(run, "doc_id long, copy long, check int, here int, hash long, mine array<string>").join(marks, "hash")
    order = ["doc_id", "copy", "check", "item_id", "here", "at", "of", "reach", "length", "width", "gap", "main", "literal", "slots", "mine"]
    outs = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32())
    names = ["doc_id", "item_id", "windows", "of", "first", "exact", "one_to_one", "copy", "check"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chains, last = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if chains is not None and (best := chains.passage()):
                row = (now[0], now[3], best[0], chains.of, *best[1:], *now[1:3])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, outs)], names)

        for batch in batches:
            for doc, copy, check, item, here, at, of, reach, length, width, gap, main, literal, slots, mine in zip(*(c.to_pylist() for c in batch.columns)):
                key = (doc, copy, check, item, of, reach, length, width)
                if key != now:
                    yield from done()
                    now, chains, last = key, _Chains(cfg, of, reach, length, width), None
                pairs = list(zip(slots, slots if literal else mine))
                if gap >= 0:
                    chains.without_one(here, at, pairs)
                elif (here, at) != last:  # repeated rows come together
                    chains.add(here, at, main, pairs)
                    last = (here, at)
        yield from done()

    keys = ["doc_id", "copy", "check", "item_id", "of", "reach", "length", "width"]
    dealt = hits.select(*order).repartition("doc_id", "copy", "item_id").sortWithinPartitions(*keys, "here", "at", F.desc("literal"), F.desc(F.size("slots")))
    found = dealt.mapInArrow(chain, "doc_id long, item_id long, windows int, of int, first int, exact boolean, one_to_one boolean, copy long, check int")
    best = F.max(F.struct("windows", "first", "exact", "one_to_one", "of", F.struct(F.col("copy").alias("hash"), "check").alias("key"))).alias("b")
    out = found.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("b.windows").cast("long").alias("windows"), F.col("b.of").alias("of"), (-F.col("b.first")).alias("start"), F.col("b.exact").alias("exact"), F.col("b.one_to_one").alias("one_to_one"), F.col("b.key").alias("text_key"))
