"""Lots of many plain texts at once: whole columns of lines and items in place of one line after another.

A plain text has letters of Western languages, digits, spaces and common marks
only, and names no lot twice; there it gives what `minutes.read` does, to which
all other texts are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import minutes as N

PLAIN = r"^[\n\x20-\x7e\x{b0}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{2013}\x{2019}\x{2022}]*$"
LOT = r"^ *(?i:lot) *(?:[nN] *[°oO]? *)?(?P<number>[0-9]{1,4})(?P<title>$|[^0-9A-Za-z_\x{c0}-\x{12f}].*$)"
LOT_MARK = r"^ *[:.–-]? *"
ITEM_MARK = r"^ *(?:[-•*]|[0-9]+[.)]) *"
ITEM_AMOUNT = r"^(?P<name>.*?) *[:=] *(?P<price>[0-9]{1,3}(?:[ .][0-9]{3})*[,.][0-9]{2}) *(?i:dhs?|mad|dirhams?)? *(?i:ttc|ht)? *\.? *$"
#: What a line without a head must have to be a status.
SAYS = r"(?i)infructueu|excessi|attribu|retenu"
#: Kinds of lines as numbers; sections follow.
OTHER, BLANK, LOT_HEAD, REFERENCE, STATUS, FIRST = range(6)
SECTION = {name: FIRST + i for i, name in enumerate(N.SECTIONS)}
BEFORE, AFTER, EXCLUDED, WINNER, _ = SECTION.values()
KIND = {None: OTHER, "": BLANK, "lot": LOT_HEAD, "reference": REFERENCE, "status": STATUS} | SECTION
HEADS = np.isin(np.arange(256), [ord(x) for x in N.HEAD_FIRST if ord(x) < 128])
BY_LINE = np.isin(np.arange(256), [ord(x) for x in N.REFERENCE_FIRST]) | (np.arange(256) >= 0xE0)
ITEMS, DIGITS = np.isin(np.arange(256), [ord(x) for x in "-*"]), np.isin(np.arange(256), [ord(x) for x in "0123456789"])


def at(x: pa.Array, rows: np.ndarray) -> pa.Array:
    return x.take(pa.array(rows, pa.int64()))


def flags(x: pa.Array) -> np.ndarray:
    return x.fill_null(False).to_numpy(zero_copy_only=False)


def plain(texts: pa.Array) -> np.ndarray:
    return flags(pc.match_substring_regex(texts, PLAIN))


def squeezed(x: pa.Array) -> pa.Array:
    x = pc.replace_substring_regex(x, " {2,}", " ") if pc.any(pc.match_substring(x, "  ")).as_py() else x
    return pc.utf8_trim(x, " ")


def first_bytes(x: pa.Array) -> np.ndarray:
    """The first byte of each string, 0 of an empty one."""
    _, offsets, data = x.buffers()
    offsets = np.frombuffer(offsets, np.int32)[x.offset : x.offset + len(x) + 1]
    out, some = np.zeros(len(x), np.uint8), offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.frombuffer(data, np.uint8)[offsets[:-1][some]]
    return out


def amounts(prices: pa.Array) -> pa.Array:
    """Prices that ITEM_AMOUNT has found, as doubles: a comma is decimal, and so is one dot; several dots are thousands."""
    bare = pc.replace_substring(prices, " ", "")
    comma = pc.match_substring(bare, ",")
    dots = pc.if_else(pc.greater(pc.count_substring(bare, "."), 1), pc.replace_substring(bare, ".", ""), bare)
    return pc.if_else(comma, pc.replace_substring(pc.replace_substring(bare, ".", ""), ",", "."), dots).cast(pa.float64())


def kinds(lines: pa.Array) -> tuple[np.ndarray, dict[int, object], np.ndarray, pa.Array, np.ndarray, pa.Array]:
    """(kind of each line, what references and statuses say, heads of sections, what stands behind them, numbers of lots, their titles); lots and heads in order."""
    kind = np.zeros(len(lines), np.int8)
    first = first_bytes(pc.utf8_ltrim(lines, " "))
    kind[first == 0] = BLANK
    says: dict[int, object] = {}
    heads = np.flatnonzero(HEADS[first])
    # heads of lots
    maybe = heads[np.isin(first[heads], [ord("l"), ord("L")])]
    found = pc.extract_regex(at(lines, maybe), LOT)
    is_lot = flags(found.is_valid())
    lots = maybe[is_lot]
    kind[lots] = LOT_HEAD
    numbers, titles = (found.filter(found.is_valid()).field(i) for i in range(2))
    titles = squeezed(pc.replace_substring_regex(titles, LOT_MARK, "", max_replacements=1))
    # heads of sections: only what stands before the first colon counts
    heads = heads[kind[heads] != LOT_HEAD]
    split = pc.split_pattern(at(lines, heads), ":", max_splits=1)
    pieces, many = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(many) - many
    before, colon = at(pieces, start).dictionary_encode(), many == 2
    keys, which = np.unique(before.indices.to_numpy() * 2 + colon, return_inverse=True)
    read = [N.token(before.dictionary[int(k) // 2].as_py() + ":" * (int(k) % 2)) for k in keys]
    own = np.array([KIND[x[0]] for x in read], np.int8)[which] if len(read) else np.zeros(0, np.int8)
    kind[heads] = own
    by_line = list(heads[(own < FIRST) & colon])
    says |= {int(i): read[k][1] for i, k in zip(heads[(own == STATUS) & ~colon], which[(own == STATUS) & ~colon], strict=True)}
    sections, has = heads[own >= FIRST], own >= FIRST
    # a section's head without a colon ends where its pattern does, at the end of the line
    rests = at(pieces, np.where(colon, start + 1, start)[has])
    if not colon[has].all():
        rests = pc.if_else(pa.array(colon[has]), rests, pa.array([read[k][2] for k in which[has]], pa.string()))
    # other lines can be references or statuses
    others = np.flatnonzero((first > 0) & ~HEADS[first] & ~ITEMS[first] & ~BY_LINE[first])
    numbered = others[DIGITS[first[others]]]
    marked = numbered[flags(pc.match_substring_regex(at(lines, numbered), ITEM_MARK))]
    others = np.setdiff1d(others, marked, assume_unique=True)
    by_line += list(others[flags(pc.match_substring_regex(at(lines, others), SAYS))]) + list(np.flatnonzero(BY_LINE[first]))
    for i in by_line:
        name, told, _ = N.token(lines[int(i)].as_py())
        kind[i] = KIND[name]
        says[int(i)] = told
    return kind, says, sections, rests, numbers.cast(pa.int32()).to_numpy(zero_copy_only=False), titles


def lots(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """(text, the columns of `minutes.lots` behind the key, texts that name a lot twice and are left out) of plain texts."""
    split = pc.split_pattern(texts, "\n")
    lines, many = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, begin = np.repeat(np.arange(len(texts)), many), np.cumsum(many) - many
    kind, says, heads, rests, numbers, titles = kinds(lines)
    opens = kind == LOT_HEAD
    starts = opens.copy()
    starts[begin] = True
    group, head = np.cumsum(starts) - 1, np.flatnonzero(starts)
    n = len(head)
    of = row[head]
    number = np.zeros(n, np.int32)
    number[group[opens]] = numbers
    title_of = np.full(n, -1)
    title_of[group[opens]] = np.arange(len(numbers))
    once, times = np.unique(of.astype(np.int64) * 10_000 + number, return_counts=True)
    twice = np.unique(once[times > 1] // 10_000)
    # the section that each line stands in
    place = np.where((kind != OTHER) | np.isin(np.arange(len(kind)), begin), np.arange(len(kind)), 0)
    section = kind[np.maximum.accumulate(place)]
    section = np.where(section >= FIRST, section, 0)
    bare = np.flatnonzero((section > 0) & (kind == OTHER))
    line = np.concatenate([bare, heads])
    order = np.argsort(line, kind="stable")
    parts = pc.split_pattern(at(pa.concat_arrays([at(lines, bare), rests]), order), ";")
    line = np.repeat(line[order], parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    names = squeezed(pc.replace_substring_regex(parts.flatten(), ITEM_MARK, "", max_replacements=1))
    some = np.flatnonzero(~flags(pc.is_in(pc.utf8_lower(names), value_set=pa.array(sorted(N.NOTHING)))))
    names, line = at(names, some), line[some]
    section, owner = section[line], group[line]
    # amounts, where a section has them
    value, priced = np.full(len(line), np.nan), np.flatnonzero((section == BEFORE) | (section == AFTER))
    found = pc.extract_regex(at(names, priced), ITEM_AMOUNT)
    good = flags(found.is_valid())
    if good.any():
        found, priced = found.filter(found.is_valid()), priced[good]
        value[priced] = amounts(found.field(1)).to_numpy(zero_copy_only=False)
        mask = np.zeros(len(line), bool)
        mask[priced] = True
        names = pc.replace_with_mask(names, pa.array(mask), pc.utf8_trim(found.field(0), " "))
    # offers by lot and name, in order of appearance
    code = names.dictionary_encode().indices.to_numpy()
    offer = np.flatnonzero(section != WINNER)
    _, appears, same = np.unique(owner[offer].astype(np.int64) * (len(code) + 1) + code[offer], return_index=True, return_inverse=True)
    in_order = np.argsort(appears, kind="stable")
    rank = np.empty(len(in_order), np.int64)
    rank[in_order] = np.arange(len(in_order))
    same, kept = rank[same], offer[appears[in_order]]
    prices = []
    for which in (BEFORE, AFTER):
        has, price = np.flatnonzero((section[offer] == which) & ~np.isnan(value[offer]))[::-1], np.full(len(kept), np.nan)
        price[same[has]] = value[offer][has]  # the first stays, for it comes last
        prices.append(pa.array(price, pa.float64(), mask=np.isnan(price)))
    excluded = np.zeros(len(kept), bool)
    excluded[same[section[offer] == EXCLUDED]] = True
    offers = pa.StructArray.from_arrays([at(names, kept), *prices, pa.array(excluded)], N.OFFER.names)
    offers = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=n))]), pa.int32()), offers)
    # the first winner and status of each lot, the first reference of each text
    winners = np.flatnonzero(section == WINNER)
    won, first = np.unique(owner[winners], return_index=True)
    winner_of = np.full(n, -1)
    winner_of[won] = winners[first]
    status, reference = np.full(n, None, object), np.full(len(texts), None, object)
    for i in sorted(says, reverse=True):
        if kind[i] == STATUS:
            status[group[i]] = says[i]
        elif kind[i] == REFERENCE:
            reference[row[i]] = says[i]
    status[(status == None) & (winner_of >= 0)] = "ATTRIBUE"  # noqa: E711
    lists = np.zeros(n, bool)
    lists[group[heads]] = True
    last = np.maximum.reduceat(number, np.flatnonzero(np.diff(of, prepend=-1))) if n else number
    keep = np.flatnonzero(((number > 0) | (last[of] == 0) | lists) & ~np.isin(of, twice))
    taken = lambda x, where: x.take(pa.array(where[keep], pa.int64(), mask=where[keep] < 0))
    title = taken(titles, title_of)
    title = pc.if_else(pc.equal(title, ""), None, title)
    columns = [pa.array(number[keep], pa.int32()), title, pa.array(reference[of[keep]], pa.string()), pa.array(status[keep], pa.string()), taken(names, winner_of), at(offers, keep)]
    return of[keep], columns, twice
