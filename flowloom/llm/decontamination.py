"""Benchmark decontamination on templates: copies of benchmark items are found even if re-parameterised.

Numbers, names and units become typed placeholders, their values slots. Windows of template words are hash-joined with
the benchmark's, and a match counts only where the slots agree: a value of the item stands for one value throughout an
occurrence of the item. A document is contaminated by an item of whose windows enough match in one occurrence.

The benchmark is a stated query set: it is sent to the tasks in blocks of bounded size (items and characters), and each
block is joined with every window of every document in one pass without a shuffle. With several blocks, what one
found is written to the shared folder before the next is made, so neither the driver nor a task ever holds two.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm._common import delete, scratch_path, slices
from flowloom.llm._words import NOT_ALNUM, SPACE, mix, range_hashes, raw

#: Number words and units of English, Spanish, French and German, but for those that are common words of another kind (articles, "once").
NUMBER_WORDS = """one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half
tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil
deux trois quatre cinq sept huit dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend""".split()
UNITS = """kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yard yards s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years l ml liter liters litre litres gallon gallons dollar dollars cent cents euro euros pound pounds percent degrees kmh mph
kilo kilos gramos metro metros kilómetros segundos minutos hora horas día días semana semanas mes meses año años litro litros pesos grados
grammes mètre mètres kilomètres secondes heure heures jour jours semaine semaines mois ans années francs degrés
gramm kilogramm meter kilometer sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren grad prozent""".split()
WORD, NUMBER, NAME, UNIT = range(4)

_code = np.arange(256)
_DIGIT = (_code >= 48) & (_code <= 57)
_LETTER = ~NOT_ALNUM & ~_DIGIT
_FIRST = _LETTER & ((_code & 0xC0) != 0x80)  # the first byte of each letter
_STOP = np.isin(_code, [ord(c) for c in ".!?\n"])


def _hashes_of(names: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(names).encode(), np.uint8)
    end = np.cumsum([len(x) for x in names])
    return np.sort(range_hashes(data, end - [len(x) for x in names], end))


@dataclass
class Template:
    """Template words of a batch: row, kind, the hash that windows are made of, and the hash of the value itself."""

    row: np.ndarray
    kind: np.ndarray
    token: np.ndarray
    value: np.ndarray


def _lowered(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts' bytes in lower case, place by place: letters whose lower case has another number of bytes stay as they are."""
    found, at = raw(pc.utf8_lower(pc.fill_null(texts, "")))
    size, given = np.diff(at), np.diff(offsets)
    if np.array_equal(size, given):
        return found
    out, same = np.zeros(len(data), np.uint8), size == given
    out[np.repeat(same, given)] = found[np.repeat(same, size)]
    for i in np.flatnonzero(~same).tolist():
        text = texts[i].as_py()
        low = {ord(c): c.lower() for c in set(text) if len(c.lower().encode()) == len(c.encode())}
        out[offsets[i] : offsets[i + 1]] = np.frombuffer(text.translate(low).encode(), np.uint8)
    return out


def template(texts: pa.Array) -> Template:
    """White-space words without the punctuation around them, in lower case; words of punctuation only are left out.

    A word of digits and no letters, one that begins with a digit, and a number word is a number; a unit's name after a
    number is a unit; a capitalised word (not all in capitals; of any script that has them) that doesn't begin a sentence is
    a name, and then it is one wherever the text has it with a capital.
    """
    data, offsets = raw(texts)
    n = len(data)
    inside = ~SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | begins[:n]))
    end = np.flatnonzero(inside & (~after | begins[1:])) + 1
    solid = np.flatnonzero(~NOT_ALNUM[data])
    low, high = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = high > low
    start, low, high = start[some], low[some], high[some]
    first, last = (solid[low], solid[high - 1] + 1) if len(solid) else (low, high)
    row = np.searchsorted(offsets, start, "right") - 1
    lower = _lowered(texts, data, offsets)
    value = range_hashes(lower, first, last)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask[data])])
    digits, letters, stops = count(_DIGIT), count(_LETTER), count(_STOP)
    number = (digits[last] > digits[first]) & ((letters[last] == letters[first]) | _DIGIT[data[first]]) if len(first) else np.zeros(0, bool)
    number |= np.isin(value, _hashes_of(NUMBER_WORDS))
    unit = np.zeros(len(row), bool)
    unit[1:] = number[:-1] & (row[1:] == row[:-1]) & ~number[1:] & np.isin(value[1:], _hashes_of(UNITS))
    opens = np.ones(len(row), bool)
    opens[1:] = (row[1:] != row[:-1]) | (stops[first[1:]] > stops[last[:-1]])
    # a letter is changed if any byte of it is; letters are counted at their first bytes
    letter = np.flatnonzero((data & 0xC0) != 0x80)
    altered = np.zeros(n, bool)
    if len(letter):
        altered[letter] = np.logical_or.reduceat(lower != data, letter)
    changed, starts = np.concatenate([[0], np.cumsum(altered)]), count(_FIRST)
    capital = altered[first] if len(first) else np.zeros(0, bool)
    capital &= changed[last] - changed[first] < starts[last] - starts[first]  # in a text all in capitals, they tell nothing
    name = capital & ~opens & ~number & ~unit
    of_row = mix(value ^ mix(row.astype(np.uint64)))
    name |= capital & opens & ~number & ~unit & np.isin(of_row, of_row[name])  # told as a name elsewhere in the text
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD)))
    return Template(row, kind, np.where(kind == WORD, value, mix(kind.astype(np.uint64))), value)


#: How words count in windows. TYPED: by their placeholders. NAMED: names as the words they are, in windows with a name, for
#: copies all in capitals or in small letters, in which no name can be told. LITERAL: all words and numbers as they are.
TYPED, NAMED, LITERAL = range(3)


def windows(t: Template, size: int, plain: int, mode: int = TYPED) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the runs of ``size`` template words in one row that hold ``plain`` ordinary words (literal ones: any) at least."""
    m = max(0, len(t.row) - size + 1)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(m, size + (mode == LITERAL) * 1000, np.uint64)
    factor = mix(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)
    token = t.value if mode == LITERAL else np.where(t.kind == NAME, t.value, t.token) if mode == NAMED else t.token
    for j in range(size):
        total += token[j : j + m] * factor[j]
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    words, names = count(t.kind == WORD), count(t.kind == NAME)
    fits = t.row[:m] == t.row[size - 1 :]
    if mode != LITERAL:
        ordinary = words + names if mode == NAMED else words
        fits &= ordinary[size:] - ordinary[:m] >= plain
    if mode == NAMED:
        fits &= names[size:] > names[:m]
    at = np.flatnonzero(fits)
    return at, mix(total[at])


@dataclass
class Group:
    """Items of one template whose values are equal at the same places: what an occurrence says of one, it says of all but for their values.

    kinds, same: of each template word, its kind and the number of its value among the item's; values: items x words; hash, place: its windows.
    """

    kinds: np.ndarray
    same: np.ndarray
    values: np.ndarray
    items: np.ndarray
    hash: np.ndarray
    place: np.ndarray
    length: int
    need: float


@dataclass
class Index:
    """Windows of many owners, sorted by hash: hash, owner, place."""

    hash: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.owner, self.place = self.hash[order], self.owner[order], self.place[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def held(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash is in the index."""
        keep = self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        some = np.flatnonzero(keep)
        at = np.minimum(np.searchsorted(self.hash, h[some]), max(0, len(self.hash) - 1))
        keep[some] = self.hash[at] == h[some] if len(self.hash) else False
        return keep

    def places(self, row: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row << 32 | owner, place) of the owners of each row's windows, each once, for some rows at a time.

        A row's different windows are looked up, so it has no more of these than the index has windows.
        """
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
        left = np.searchsorted(self.hash, h, "left")
        count = np.searchsorted(self.hash, h, "right") - left
        begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        total, start = np.concatenate([[0], np.cumsum(count)]), 0
        for i in range(len(begins)):
            end = begins[i + 1] if i + 1 < len(begins) else len(row)
            if i + 1 < len(begins) and total[begins[i + 1]] - total[start] < LOOKED_UP:
                continue
            c = count[start:end]
            k = np.arange(c.sum()) + np.repeat(left[start:end] - np.cumsum(c) + c, c)
            pair = np.repeat(row[start:end], c).astype(np.int64) << 32 | self.owner[k]
            both = np.unique(np.stack([pair, self.place[k].astype(np.int64)], 1), axis=0) if len(k) else np.zeros((0, 2), np.int64)
            yield both[:, 0], both[:, 1]
            start = end


#: Owners of windows that are looked up at once, besides those of one more row.
LOOKED_UP = 1 << 20


@dataclass
class Block:
    """Part of the benchmark. Typed windows belong to groups, those with names to parts of groups with equal names, literal ones to items."""

    size: int
    plain: int
    names: list
    groups: list[Group]
    parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    typed: Index
    named: Index
    literal: Index
    need: np.ndarray
    lengths: dict[int, list[int]]


def _by_rows(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of equal rows: the first's number, and each row's place among the different ones."""
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(r, len(seen)) for r in rows], np.int64)
    first = np.zeros(len(seen), np.int64)
    first[of[::-1]] = np.arange(len(rows))[::-1]
    return first, of


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, plain: int, share: float, block_items: int, block_chars: int) -> Iterator[Block]:
    """Benchmark blocks of about ``block_items`` items and ``block_chars`` characters. Null texts and texts without a window are in none.

    An item of fewer than ``size`` template words is one window of its own length, all of ordinary words. An item without
    such windows (formulas, lists of numbers, short questions with numbers) has literal ones, of its own length if that is less. Such short
    ones have two words at least, one of them no number: a few numbers in a row are everywhere.
    """
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // block_items), -(-chars // block_chars))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("text", "id"), F.lit(parts)))
    for p in range(parts):
        rows = dealt.where(F.col("part") == p).select("id", "text").toArrow()  # bounded as above, on average over the parts
        if rows.num_rows:
            yield _block(rows.column("text").combine_chunks(), rows.column("id").to_pylist(), size, plain, share)


def _block(texts: pa.Array, ids: list, size: int, plain: int, share: float) -> Block:
    t = template(texts)
    cut = np.searchsorted(t.row, np.arange(len(ids) + 1))
    lengths = np.minimum(np.diff(cut), size)
    worded = np.bincount(t.row[(t.kind == WORD) | (t.kind == NAME)], minlength=len(ids)) > 0
    bare = (lengths > 1) & (worded | (lengths == size))  # until a window of the other sorts is found
    found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for mode in (TYPED, NAMED, LITERAL):
        made = []
        for k in sorted(set(lengths.tolist()) - {0}):
            at, h = windows(t, k, min(plain, k), mode)
            mine = (lengths[t.row[at]] == k) & (bare[t.row[at]] if mode == LITERAL else True)
            made.append((h[mine], t.row[at[mine]], at[mine] - cut[t.row[at[mine]]]))
        found[mode] = tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        bare[found[mode][1]] = False if mode != LITERAL else bare[found[mode][1]]
    both = np.unique(np.concatenate([np.stack(found[m][1:], 1).astype(np.int64) for m in found]), axis=0)
    need = share * np.bincount(both[:, 0], minlength=len(ids))
    each = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    same = [np.unique(mix(t.value[s] ^ mix(t.kind[s].astype(np.uint64))), return_inverse=True)[1] for s in each]
    # the number of a value is that of its first place, so that equal numbers say equal patterns
    same = [x if not len(x) else np.unique(x, return_index=True)[1][x] for x in same]
    of_item = lambda mode: np.searchsorted(order[mode][1], np.arange(len(ids) + 1))
    order = {m: tuple(x[np.argsort(found[m][1], kind="stable")] for x in found[m]) for m in (TYPED, NAMED)}
    windowed = np.flatnonzero(np.isin(np.arange(len(ids)), np.concatenate([found[TYPED][1], found[NAMED][1]])))
    typed_cut, named_cut = of_item(TYPED), of_item(NAMED)
    slotted = [np.where(t.kind[s] == WORD, -1, x) for s, x in zip(each, same, strict=True)]
    first, of = _by_rows([t.token[each[i]].tobytes() + slotted[i].tobytes() for i in windowed.tolist()])
    split = lambda owner, n: np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=n))[:-1]) if n else []
    groups, typed, members = [], [], [windowed[x] for x in split(of, len(first))]
    for g, i in enumerate(windowed[first].tolist()):
        a, b = typed_cut[i], typed_cut[i + 1]
        h, place = order[TYPED][0][a:b], order[TYPED][2][a:b]
        groups.append(Group(t.kind[each[i]], slotted[i], np.stack([t.value[each[j]] for j in members[g].tolist()]), members[g], h, place, int(lengths[i]), need[i]))
        typed.append((h, np.full(len(h), g), place))
    fine, of_part = _by_rows([bytes(order[NAMED][0][named_cut[i] : named_cut[i + 1]]) + int(g).to_bytes(8, "little") for i, g in zip(windowed.tolist(), of, strict=True)])
    parts, named = [], []
    inside = np.zeros(len(windowed), np.int64)  # each item's place within its group
    for g in members:
        inside[np.searchsorted(windowed, g)] = np.arange(len(g))
    for k, mine in enumerate(split(of_part, len(fine))):
        i = int(windowed[fine[k]])
        h, place = (order[NAMED][x][named_cut[i] : named_cut[i + 1]] for x in (0, 2))
        parts.append((int(of[fine[k]]), inside[mine], h, place))
        named.append((h, np.full(len(h), k), place))
    whole = lambda made: Index(*(np.concatenate(x) for x in zip(*made, strict=True))) if made else Index(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    every = sorted({int(lengths[i]) for i in windowed.tolist()})
    used = {TYPED: every, NAMED: every, LITERAL: sorted({int(lengths[i]) for i in found[LITERAL][1].tolist()})}
    return Block(size, plain, ids, groups, parts, whole(typed), whole(named), Index(*found[LITERAL]), need, used)


def _readings(group: Group, own: np.ndarray, found: list[tuple[int, int]]) -> Iterator[set[int]]:
    """What occurrences say: for each, the places in the item whose windows agree with it. ``found`` has each hit's place in the document and in the item.

    Each diagonal (place in the document less place in the item) is read as an occurrence: it says what each value of
    the item stands for, and hits at most the item's length away count if they agree with it, so that words put in or left
    out cost only the windows around them. The whole document is read too, for occurrences torn further apart.
    """
    n = group.length
    slots = [[(int(group.same[q + j]), int(own[p + j]), p + j, q + j) for j in range(n) if group.same[q + j] >= 0] for p, q in found]

    def usual(which: list[int], given: dict) -> dict:
        stands = defaultdict(Counter)
        for v, w, _, _ in {x for k in which for x in slots[k] if x[0] not in given}:
            stands[v][w] += 1
        return given | {v: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for v, c in stands.items()}

    def agreeing(which: list[int], given: dict) -> set[int]:
        stands = usual(which, given)
        return {found[k][1] for k in which if all(stands[v] == w for v, w, _, _ in slots[k])}

    yield agreeing(list(range(len(found))), {})
    order = sorted(range(len(found)), key=lambda k: found[k][0])
    places = [found[k][0] for k in order]
    diagonals = defaultdict(list)
    for k in order:
        diagonals[found[k][0] - found[k][1]].append(k)
    tried = set()
    for seed in sorted(diagonals.values(), key=len, reverse=True):
        given = usual(seed, {})
        near = order[bisect_left(places, found[seed[0]][0] - len(group.kinds)) : bisect_right(places, found[seed[-1]][0] + len(group.kinds))]
        key = (frozenset(given.items()), near[0], near[-1])
        if key not in tried:
            tried.add(key)
            yield agreeing([k for k in near if all(given.get(v, w) == w for v, w, _, _ in slots[k])], given)


def _matching(group: Group, rows: np.ndarray, own: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the group's items (of its ``rows``) occur: enough of their windows agree with one reading, or have the item's own values.

    Windows with the item's own values count in every occurrence. They are compared for all items of the group at once.
    """
    places, n = np.unique(q), group.length
    spot = {int(x): i for i, x in enumerate(places)}
    read = set()
    for agree in _readings(group, own, list(zip(p.tolist(), q.tolist(), strict=True))):
        if len(agree) >= group.need:
            return rows
        read.add(frozenset(agree))
    said = np.zeros((len(read), len(places)), np.float32)
    for i, agree in enumerate(read):
        said[i, [spot[x] for x in agree]] = 1
    out = []
    for lot in np.array_split(rows, max(1, len(rows) // 4096)):
        verbatim = np.zeros((len(lot), len(places)), np.float32)
        for i, x in enumerate(places.tolist()):
            at = np.flatnonzero(group.same[x : x + n] >= 0)
            seen, mine = np.zeros(int((q == x).sum()), np.uint64), np.zeros(len(lot), np.uint64)
            for j in at.tolist():
                seen, mine = mix(seen + own[p[q == x] + j]), mix(mine + group.values[lot, x + j])
            verbatim[:, i] = np.isin(mine, seen)
        most = verbatim.sum(1) + ((1 - verbatim) @ said.T).max(1, initial=0)
        out.append(lot[most >= group.need])
    return np.concatenate(out)


def matches(block: Block, texts: pa.Array) -> dict[int, list[int]]:
    """Row -> items of the block (by index) that contaminate it."""
    t = template(texts)
    out: dict[int, set[int]] = defaultdict(set)
    looked = {(n, m): windows(t, n, min(block.plain, n), m) for m, lengths in block.lengths.items() for n in lengths}

    def hits(modes: tuple[int, ...], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of the windows that the index holds, by row and hash, and where each row's begin."""
        made = [looked[n, m] for m in modes for n in block.lengths[m]]
        at, h = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        keep = index.held(h)
        at, h = at[keep], h[keep]
        order = np.lexsort((at, h, t.row[at]))
        return at[order], h[order], np.searchsorted(t.row[at[order]], np.arange(len(texts) + 1))

    def occurrences(found: tuple[np.ndarray, np.ndarray, np.ndarray], row: int, hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """(place in the document, place in the item) of every window of a row that has one of ``hashes``."""
        at, h, cut = found
        mine = h[cut[row] : cut[row + 1]]
        left = np.searchsorted(mine, hashes, "left")
        count = np.searchsorted(mine, hashes, "right") - left
        k = np.arange(count.sum()) + np.repeat(left - np.cumsum(count) + count, count)
        return np.stack([at[cut[row] : cut[row + 1]][k], np.repeat(places, count)], 1).astype(np.int64)

    def owners(found: tuple[np.ndarray, np.ndarray, np.ndarray], index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row << 32 | owner) and how many different places of the owner the row has."""
        for pair, _ in index.places(t.row[found[0]], found[1]):
            yield np.unique(pair, return_counts=True)

    for pair, count in owners(hits((LITERAL,), block.literal), block.literal):  # these windows have the item's own values
        for x in pair[count >= block.need[pair & 0xFFFFFFFF]].tolist():
            out[x >> 32].add(x & 0xFFFFFFFF)
    # names in a text all in capitals or small letters are words, so windows of either sort may be the other's
    typed, need = hits((TYPED, NAMED), block.typed), np.array([g.need for g in block.groups])
    for pair, count in owners(typed, block.typed):
        for x in pair[count >= need[pair & 0xFFFFFFFF]].tolist():  # others cannot have matches enough, whatever their slots
            row, group = x >> 32, block.groups[x & 0xFFFFFFFF]
            both = occurrences(typed, row, group.hash, group.place)
            out[row].update(group.items[_matching(group, np.arange(len(group.items)), t.value, both[:, 0], both[:, 1])].tolist())
    named = hits((TYPED, NAMED), block.named)
    for pair, _ in owners(named, block.named):
        for x in pair.tolist():
            row, (g, inside, hashes, places) = x >> 32, block.parts[x & 0xFFFFFFFF]
            group = block.groups[g]
            left = inside[~np.isin(group.items[inside], list(out[row]))]
            if not len(left):
                continue
            both = np.unique(np.concatenate([occurrences(typed, row, group.hash, group.place), occurrences(named, row, hashes, places)]), axis=0)
            if len(np.unique(both[:, 1])) >= group.need:
                out[row].update(group.items[_matching(group, left, t.value, both[:, 0], both[:, 1])].tolist())
    return {row: sorted(items) for row, items in out.items() if items}


def _finder(sent, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows end in items and text; the ids that this block adds go to items, and text goes on if ``keep_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for part in slices(batches, "text"):
            found = matches(block, part.column("text"))
            items = part.column("items").to_pylist()
            for r, new in found.items():
                items[r] = [*items[r], *(block.names[i] for i in new)]
            made = [pa.array(items, part.schema.field("items").type), *([part.column("text")] if keep_text else [])]
            yield pa.record_batch([*part.columns[:-2], *made], names=part.schema.names[: len(part.columns) - 2 + len(made)])

    return run


def contaminated_by(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", size: int = 8, plain: int = 4, share: float = 0.5, block_items: int = 50_000, block_chars: int = 50_000_000) -> DataFrame:
    """Every row's ``carry`` columns (all, if not given) with ``items``: the ids of the benchmark items that contaminate it, in order.

    An item does if ``share`` of its windows match with slots that agree. A null or empty text has none; texts of any length
    are read whole. Items of a null
    id are one null at the end of ``items``, so they mark a document without naming it; items that share a text are each
    named. Rows that repeat are each judged; an existing column ``items`` is replaced.
    """
    spark, kind = docs.sparkSession, benchmark.schema[item_col].dataType.simpleString()
    carry = [c for c in docs.columns if c != "items"] if carry is None else carry
    other = [c for c in carry if c != text_col]
    names = [f"c{i}" for i in range(len(other))]
    kinds = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(other)), f"items array<{kind}>"])
    rows = docs.select(*(F.col(f"`{c}`") for c in other), F.array().cast(f"array<{kind}>"), F.col(text_col)).toDF(*names, "items", "text")
    made, last = blocks(benchmark, item_col, item_text_col, size, plain, share, block_items, block_chars), None
    block = next(made, None)
    while block is not None:
        sent = spark.sparkContext.broadcast(block)
        block = next(made, None)  # the next is only made to see whether there is one; the one sent is in the broadcast alone
        keep = text_col in carry or block is not None
        rows = rows.mapInArrow(_finder(sent, keep), kinds + ", text string" * keep)
        if block is not None:
            path = scratch_path(spark, "decontamination")
            rows.write.parquet(path)
            rows = spark.read.schema(rows.schema).parquet(path)
            sent.destroy()
            if last:
                delete(spark, last)
            last = path
    out = rows.withColumn("items", F.array_sort(F.array_distinct("items")))
    return out.select(*(F.col("text" if c == text_col else names[other.index(c)]).alias(c) for c in carry), "items")


def is_clean(items: Column) -> Column:
    return F.size(items) == 0
