"""A context-mixing model of token sequences: codes of words, hashed-context predictors of their bits, gated weights."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

#: Hashed contexts: the orders, and the bits of a slot's number at most. Tables have a slot for each token that they are
#: learned from, up to this many; 4 bytes a slot.
ORDERS, SLOT_BITS = (1, 2), 22
#: Bits of a context's hash that tell contexts apart: as many as the number of a slot and its check have.
CONTEXT_BITS = 36
#: Predictors of a bit: the words' frequencies, the two hashed contexts, and the document so far.
INPUTS, GATES = 4, 12
#: Weights are refined after each block of so many tokens of a document, at this rate, within these bounds.
BLOCK, RATE, LIMIT = 64, 0.003, 8.0
#: Tokens whose bits are laid out at once; weights, contexts and what a document has had so far go on from one such lot to
#: the next.
LOT = 1 << 15
#: Documents that go on side by side at most, and bits whose chances are multiplied before a logarithm is taken: 16 factors
#: of at most e^30 + 1 stay in range.
TOGETHER, FACTORS = 1024, 16
WIDTH = 48
#: Words that are spelled at once.
WORDS = 5_000
_START = np.uint64(0xA0761D6478BD642F)
#: States of each of the three predictors beside frequency: without a say (0), failing at level v (2v - 1), or holding (2v);
#: the document has two levels. A bit's state is made of theirs, the last one's varying fastest.
STATES = (7, 7, 5)
STEPS, ALL_STATES = (35, 5, 1), 245
#: What a fit counts bits by: their chance by frequency, so many bins a unit of its logit up to this, and their state.
BINS_A_UNIT, REACH = 4, 14
CELLS = (2 * REACH * BINS_A_UNIT + 1) * ALL_STATES
#: The place among weights laid by the levels of the last two predictors for each of their states.
_GATE_OF = ((np.arange(7)[:, None] + 1) // 2 * 3 + (np.arange(5) + 1) // 2).ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def ordered(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys: by their high bits with the places below, sorted as plain numbers; keys that share those
    bits and differ, which hashes hardly do, need the slower way."""
    low = np.uint64(len(keys).bit_length())
    packed = ((keys >> low) << low) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    packed >>= low
    found = keys.take(order)
    if ((packed[1:] == packed[:-1]) & (found[1:] != found[:-1])).any():
        return np.argsort(keys, kind="stable")
    return order


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of a Huffman code; ties go to the earlier symbol. A single symbol gets one bit."""
    if len(counts) == 1:
        return [1]
    heap = [(n, k, None) for k, n in enumerate(counts)]
    heapify(heap)
    more = len(counts)
    while len(heap) > 1:
        a, b = heappop(heap), heappop(heap)
        heappush(heap, (a[0] + b[0], more, (a, b)))
        more += 1
    lengths, todo = [0] * len(counts), [(heap[0], 0)]
    while todo:
        (_, k, below), depth = todo.pop()
        if below is None:
            lengths[k] = depth
        else:
            todo += [(below[0], depth + 1), (below[1], depth + 1)]
    return lengths


@dataclass
class Code:
    """A canonical prefix code of symbols, and how likely each bit of each symbol's code is by the symbols' counts."""

    counts: np.ndarray
    lengths: np.ndarray = field(init=False)
    codes: np.ndarray = field(init=False)
    offsets: np.ndarray = field(init=False)
    stretched: np.ndarray = field(init=False)

    def __post_init__(self):
        counts = np.maximum(np.asarray(self.counts, np.int64), 1)
        lengths = np.array(code_lengths(counts.tolist()), np.int64)
        order = np.lexsort((np.arange(len(counts)), lengths))
        codes, at, before = np.zeros(len(counts), np.uint64), 0, 0
        for k in order.tolist():
            at <<= int(lengths[k]) - before
            before = int(lengths[k])
            codes[k] = at << (WIDTH - before)
            at += 1
        # In canonical order the symbols below a node are a stretch, so sums of counts give each node's.
        upto = np.concatenate([[0.0], np.cumsum(counts[order])])
        sorted_codes = codes[order]
        self.lengths, self.codes = lengths, codes
        self.offsets = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(counts)), lengths)
        depth = np.arange(len(owner)) - np.repeat(self.offsets, lengths)

        def under(bits: np.ndarray) -> np.ndarray:
            low = (codes[owner] >> (WIDTH - bits).astype(np.uint64)) << (WIDTH - bits).astype(np.uint64)
            high = low + (np.uint64(1) << (WIDTH - bits).astype(np.uint64))
            return upto[np.searchsorted(sorted_codes, high)] - upto[np.searchsorted(sorted_codes, low)]

        node, child = under(depth), under(depth + 1)
        p = np.clip(child / node, 1e-6, 1 - 1e-6)
        self.stretched = np.log(p / (1 - p)).astype(np.float32)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many leading bits the codes of two symbols share; all for the same symbol."""
        exponent = np.frexp((self.codes.take(a) ^ self.codes.take(b)).astype(np.float64))[1]
        return np.minimum(WIDTH - exponent, self.lengths.take(a))


@dataclass
class Counts:
    """How often each symbol followed each hashed context: ascending numbers, of CONTEXT_BITS of the context's hash and 16 of
    the symbol, and a count for each."""

    numbers: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, numbers: np.ndarray) -> Counts:
        numbers = np.sort(numbers)
        firsts = np.flatnonzero(np.diff(numbers, prepend=~numbers[:1]))
        return cls(numbers[firsts], np.diff(firsts, append=len(numbers)))

    @classmethod
    def summed(cls, parts: list[Counts]) -> Counts:
        numbers, counts = (np.concatenate([getattr(p, f) for p in parts]) for f in ("numbers", "counts"))
        order = np.argsort(numbers, kind="stable")
        numbers = numbers[order]
        firsts = np.flatnonzero(np.diff(numbers, prepend=~numbers[:1]))
        return cls(numbers[firsts], np.add.reduceat(counts[order], firsts) if len(firsts) else counts)

    def cut(self, bits: int) -> list[Counts]:
        """By the first bits of the numbers."""
        ends = np.searchsorted(self.numbers, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(CONTEXT_BITS + 16 - bits)) if bits else []
        return [Counts(n, c) for n, c in zip(np.split(self.numbers, ends), np.split(self.counts, ends), strict=True)]

    def to_bytes(self) -> bytes:
        """The first number, and steps from number to number and counts, byte by byte of all of them, as many bytes as the
        largest needs, so that the zeros of the high ones lie together."""
        steps, counts = np.diff(self.numbers, prepend=self.numbers[:1]), self.counts.astype(np.uint64)
        used = [(int(x.max()).bit_length() + 7) // 8 if len(x) else 0 for x in (steps, counts)]
        planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:n]).tobytes() for x, n in zip((steps, counts), used, strict=True)]
        return b"".join([bytes(used), self.numbers[:1].tobytes(), *planes])

    @classmethod
    def from_bytes(cls, data: bytes) -> Counts:
        if len(data) == 2:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        rows = np.frombuffer(data, np.uint8, offset=10).reshape(data[0] + data[1], -1)
        out = np.zeros((2, rows.shape[1], 8), np.uint8)
        out[0, :, : data[0]], out[1, :, : data[1]] = rows[: data[0]].T, rows[data[0] :].T
        steps, counts = out.reshape(2, -1).view(np.uint64)
        return cls(np.frombuffer(data, np.uint64, 1, 2) + np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64))


@dataclass
class Table:
    """For each slot of a hashed context the symbol that followed most, with a check of the context and how far to trust
    it (0: an empty slot)."""

    symbol: np.ndarray
    mark: np.ndarray
    CHECK_BITS = 14

    @classmethod
    def empty(cls, bits: int) -> Table:
        return cls(np.zeros(1 << bits, np.uint16), np.zeros(1 << bits, np.uint16))

    @classmethod
    def chosen(cls, found: Counts, bits: int, first: int = 0, slots: int | None = None) -> Table:
        """The slots from ``first`` on, of 2**bits. A slot goes to the context whose most frequent successor has the
        greatest count, on a tie to the greater hash; a context's to the most frequent, on a tie the greater symbol."""
        table = cls.empty(0)
        table.symbol, table.mark = (np.zeros((1 << bits) if slots is None else slots, np.uint16) for _ in range(2))
        if not len(found.numbers):
            return table
        context = (found.numbers >> np.uint64(16)).astype(np.int64)
        begins = np.flatnonzero(np.diff(context, prepend=-1))
        best = np.maximum.reduceat((found.counts << 16) | (found.numbers & np.uint64(0xFFFF)).astype(np.int64), begins)
        context = context[begins]
        slot = context >> (CONTEXT_BITS - bits)
        firsts = np.flatnonzero(np.diff(slot, prepend=-1))
        most = np.repeat(np.maximum.reduceat(best >> 16, firsts), np.diff(firsts, append=len(slot)))
        won = np.maximum.reduceat(np.where(best >> 16 == most, np.arange(len(slot)), -1), firsts)
        check = (context[won] >> (CONTEXT_BITS - bits - cls.CHECK_BITS)) & ((1 << cls.CHECK_BITS) - 1)
        table.symbol[slot[won] - first] = best[won] & 0xFFFF
        table.mark[slot[won] - first] = (check << 2) | _level(best[won] >> 16)
        return table

    def found(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The predicted symbol and its level for each context's hash."""
        bits = len(self.symbol).bit_length() - 1
        slot = (hashed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashed), np.int64)
        check = ((hashed >> np.uint64(64 - bits - self.CHECK_BITS)) & np.uint64((1 << self.CHECK_BITS) - 1)).astype(np.uint16)
        mark = self.mark.take(slot)
        return self.symbol.take(slot).astype(np.int64), np.where(mark >> 2 == check, mark & 3, 0).astype(np.int8)


def contexts(words: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hashes of the one and of the two words before each token of a document."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = _START
    second = np.empty_like(words)
    second[1:] = before[:-1]
    second[starts] = _START
    return [mixed(before + np.uint64(1)), mixed(mixed(before + np.uint64(2)) + second)]


def gathered(words: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For each order, a number for each token: bits of its context's hash and the symbol that followed."""
    return [((hashed >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(16)) | symbols.astype(np.uint64) for hashed in contexts(words, starts)]


def _level(count: np.ndarray) -> np.ndarray:
    return (count > 0).astype(np.int8) + (count > 1) + (count > 3)


@dataclass
class Mixer:
    """The model: the code, the tables, what a predictor at each level is worth, and the weights to start from."""

    code: Code
    tables: list[Table]
    strengths: np.ndarray = field(default_factory=lambda: np.array([[0, 1, 2, 3], [0, 2, 3, 4], [0, 1, 3, 3]], np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.tile(np.array([1, 0.3, 0.3, 0.3], np.float32), (GATES, 1)))

    def predictions(self, words, symbols, starts, documents):
        """For each token three predicted symbols' common bits with the true one and their levels (0: none); and
        whether the document predicts a word that has no symbol of its own, and is right."""
        found = []
        for table, hashed in zip(self.tables, contexts(words, starts), strict=True):
            predicted, level = table.found(hashed)
            found.append((self.code.common(symbols, predicted), level))
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[starts] = _START
        key = mixed(before) + documents.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = ordered(key)
        again = np.zeros(len(key), bool)
        sorted_key = key.take(order)
        again[1:] = sorted_key[1:] == sorted_key[:-1]
        last = np.full(len(key), -1)
        last[order[1:]] = np.where(again[1:], order[:-1], -1)
        seen = last >= 0
        twice = seen & (last[last] >= 0) & (words[last] == words[last[last]])
        found.append((self.code.common(symbols, symbols[last]), seen.astype(np.int8) + twice))
        return found, seen & (symbols[last] == symbols), seen & (words[last] == words)

    def worths(self) -> list[np.ndarray]:
        """What each predictor says in each of its states, in favour of what is true."""
        return [np.where((s := np.arange(n)) == 0, 0, np.where(s % 2, -1, 1)).astype(np.float32) * self.strengths[k].take((s + 1) // 2) for k, n in enumerate(STATES)]

    def laid_out(self, symbols, found, base):
        """The bits of symbols in a row: the place of each in ``code.stretched``, its state added to its token's number in
        ``base``, and the tokens' ends. A predictor holds from a token's first bit on, fails at the bit that its symbol
        differs in, and is without a say from then on; so states are sums of steps at a few bits of each token."""
        lengths = self.code.lengths.take(symbols)
        ends = np.cumsum(lengths)
        starts, total = ends - lengths, int(ends[-1])
        steps, first, last = np.zeros(total + 1, np.int64), base.copy(), base.copy()
        for (common, level), step in zip(found, STEPS, strict=True):
            held = level.astype(np.int64) * (2 * step)
            failing = held - step * (level > 0)
            fails, over = common < lengths, common + 1 < lengths
            at = starts + common
            first += held
            last += np.where(fails, np.where(over, 0, failing), held)
            steps[np.where(fails, at, total)] += failing - held  # at a place only once; the last one is of no use
            steps[np.where(over, at + 1, total)] -= failing
        first[1:] -= last[:-1]
        steps[starts] += first
        places = np.arange(total)
        places += np.repeat(self.code.offsets.take(symbols) - starts, lengths)
        return places, np.cumsum(steps[:-1]), ends

    def bits(self, words, symbols, counts):
        """The bits that the symbols of each document cost, in order; and for each token whether the document predicted
        its symbol and its word. Documents go on side by side, block by block, each with weights of its own."""
        n, ends = len(counts), np.cumsum(counts)
        found, same_symbol, same_word = self.predictions(words, symbols, ends - counts, np.repeat(np.arange(n, dtype=np.int32), counts))
        cost = np.zeros(n)
        for at in range(0, n, TOGETHER):
            some = slice(int(ends[at] - counts[at]), int(ends[min(at + TOGETHER, n) - 1]))
            cost[at : at + TOGETHER] = self._paid(symbols[some], [(common[some], level[some]) for common, level in found], counts[at : at + TOGETHER])
        return cost / np.log(2), same_symbol, same_word

    def _paid(self, symbols, found, counts):
        """What the bits of each document cost; weights are refined after each block."""
        n = len(counts)
        documents = np.repeat(np.arange(n), counts)
        blocks = (np.arange(len(symbols)) - (np.cumsum(counts) - counts)[documents]) // BLOCK
        order = np.argsort(blocks, kind="stable")
        begins = np.append(np.flatnonzero(np.diff(blocks[order], prepend=-1)), len(order))
        # By input and by the levels of the last two predictors.
        weights = np.tile(self.weights.reshape(3, 4, INPUTS).transpose(2, 1, 0).reshape(INPUTS, GATES), (n, 1, 1)).astype(np.float32)
        one, two, three = self.worths()
        worths, cost, at = (one[:, None], np.repeat(two, len(three)), np.tile(three, len(two))), np.zeros(n), 0
        while at < len(begins) - 1:
            upto = max(at + 1, int(np.searchsorted(begins, begins[at] + LOT, side="right")) - 1)
            lot = order[begins[at] : begins[upto]]
            owners = documents[lot]
            news = np.diff(owners, prepend=-1) != 0
            news[begins[at:upto] - begins[at]] = True
            firsts = np.flatnonzero(news)  # of the documents in each block
            heads = np.searchsorted(firsts, begins[at : upto + 1] - begins[at])
            numbers = np.arange(len(firsts)) - np.repeat(heads[:-1], np.diff(heads))
            base = np.repeat(numbers * ALL_STATES, np.diff(firsts, append=len(lot)))
            places, cells, ends = self.laid_out(symbols[lot], [(common[lot], level[lot]) for common, level in found], base)
            x = self.code.stretched.take(places)
            del places
            edges = np.append(ends[firsts] - self.code.lengths.take(symbols[lot[firsts]]), len(x))
            for head, end in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                some, own = slice(int(edges[head]), int(edges[end])), owners[firsts[head:end]]
                cost[own] += self._block(x[some], cells[some], edges[head : end + 1] - edges[head], own, weights, worths)
            at = upto
        return cost

    def _block(self, x, cells, edges, own, weights, worths):
        """What the bits of one block of documents cost; it refines their weights."""
        n, (one, two, three) = len(own), worths
        before = weights[own]
        wide = before.take(_GATE_OF, axis=2)
        said = (wide[:, 2] * two + wide[:, 3] * three)[:, None] + wide[:, 1, None] * one
        z = np.repeat(wide[:, :1], len(one), axis=1).ravel().take(cells)
        z *= x
        z += said.ravel().take(cells)
        np.clip(z, -30, 30, out=z)
        e = np.exp(-z)
        u = e + np.float64(1)
        lots = (edges[1:] - edges[:-1] + (FACTORS - 1)) // FACTORS
        firsts = lots.cumsum()
        cuts = np.arange(firsts[-1]) * FACTORS
        firsts -= lots
        cuts += np.repeat(edges[:-1] - firsts * FACTORS, lots)
        cost = np.add.reduceat(np.log(np.multiply.reduceat(u, cuts)), firsts)
        wrong = np.divide(e, u, out=u)
        each = np.bincount(cells, weights=wrong, minlength=n * ALL_STATES).reshape(n, len(one), -1)
        wrong *= x
        steps, total = np.empty((n, INPUTS, each.shape[2])), each.sum(axis=1)
        steps[:, 0] = np.bincount(cells, weights=wrong, minlength=n * ALL_STATES).reshape(each.shape).sum(axis=1)
        each *= one
        steps[:, 1] = each.sum(axis=1)
        steps[:, 2], steps[:, 3] = total * two, total * three
        steps = steps.reshape(n, INPUTS, *STATES[1:])
        # Failing or holding at a level is the same gate.
        rows = steps.take([0, 1, 3, 5], axis=2)
        rows[:, :, 1:] += steps[:, :, 2::2]
        levels = rows.take([0, 1, 3], axis=3)
        levels[..., 1:] += rows[..., 2::2]
        before += RATE * levels.reshape(before.shape)
        weights[own] = np.clip(before, -LIMIT, LIMIT, out=before)
        return cost

    def observed(self, words, symbols, counts) -> np.ndarray:
        """What a fit needs to know of documents that the tables haven't seen, as numbers that add up over documents: how
        many bits are in each cell (by frequency, in favour of what is true, and by each predictor's state: without a say,
        or its level and whether it fails here or holds); then how often the document predicts a word without a symbol of
        its own, and how often it is right."""
        starts = np.cumsum(counts) - counts
        found, same_symbol, same_word = self.predictions(words, symbols, starts, np.repeat(np.arange(len(counts)), counts))
        bins = (np.clip(np.rint(self.code.stretched * BINS_A_UNIT), -REACH * BINS_A_UNIT, REACH * BINS_A_UNIT).astype(np.int64) + REACH * BINS_A_UNIT) * ALL_STATES
        out = np.zeros(CELLS + 2, np.int64)
        tokens = symbols.astype(np.int64)  # with what is predicted: many are alike
        for common, level in found:
            tokens = (tokens << 8) | np.where(level > 0, (common << 2) | level, 0)
        tokens.sort()
        firsts = np.flatnonzero(np.diff(tokens, prepend=-1))
        tokens, times = tokens[firsts], np.diff(firsts, append=len(tokens))
        for at in range(0, len(tokens), LOT):
            some = tokens[at : at + LOT]
            own = some >> 24
            places, cells, _ = self.laid_out(own, [((some >> by & 255) >> 2, some >> by & 3) for by in (16, 8, 0)], np.zeros(len(some), np.int64))
            cells += bins.take(places)
            out[:CELLS] += np.bincount(cells, weights=np.repeat(times[at : at + LOT], self.code.lengths.take(own)), minlength=CELLS).astype(np.int64)
        rare = same_symbol & (symbols == len(self.code.counts) - 2)
        out[CELLS:] = rare.sum(), (rare & same_word).sum()
        return out

    def fitted_to(self, observed: np.ndarray) -> Mixer:
        """Strengths from how often each predictor is right at each level, and weights by logistic regression for each
        gate, over all that was observed."""
        counts = observed[:CELLS].reshape(-1, *STATES)
        strengths = self.strengths.copy()
        for k, n in enumerate(STATES):
            each = counts.sum(axis=tuple(x for x in range(4) if x != k + 1))
            for value in range(1, (n + 1) // 2):
                wrong, right = float(each[2 * value - 1]), float(each[2 * value])
                if right + wrong > 50:
                    strengths[k, value] = np.clip(np.log((right + 1) / (wrong + 1)), -4, 6)
        model = Mixer(self.code, self.tables, strengths, self.weights.copy())
        cells = np.flatnonzero(observed[:CELLS])
        n = observed[cells].astype(np.float64)
        states = [cells // step % size for step, size in zip(STEPS, STATES, strict=True)]
        x = np.array([cells // ALL_STATES / BINS_A_UNIT - REACH, *(worth.take(s).astype(np.float64) for worth, s in zip(model.worths(), states, strict=True))])
        gate = (states[1] + 1) // 2 + 4 * ((states[2] + 1) // 2)
        for g in range(GATES):
            those = gate == g
            if n[those].sum() < 200:
                continue
            own, times, w = x[:, those], n[those], model.weights[g].astype(np.float64)
            for _ in range(12):
                p = 1 / (1 + np.exp(-np.clip(w @ own, -30, 30)))
                gradient = own @ (times * (1 - p)) - 1.0 * (w - np.array([1, 0.3, 0.3, 0.3]))
                hessian = (own * (times * p * (1 - p))) @ own.T + np.eye(INPUTS)
                step = np.linalg.solve(hessian, gradient)
                w = np.clip(w + np.clip(step, -1, 1), -LIMIT, LIMIT)
                if np.abs(step).max() < 1e-4:
                    break
            model.weights[g] = w
        return model

    def fitted(self, words, symbols, counts) -> Mixer:
        """Fitted to documents that the tables haven't seen."""
        return self.fitted_to(self.observed(words, symbols, counts))


@dataclass
class Spelling:
    """Bits of a word's spelling: each character's code bits, predicted under three hashed contexts within the word."""

    code: Code
    alphabet: dict[int, int]
    table: np.ndarray
    weights: np.ndarray
    BITS = 19

    @classmethod
    def learned(cls, words: list[bytes] | pa.Array) -> Spelling:
        """From distinct words, each once."""
        spelling = cls.empty(cls.characters(words))
        spelling.table = spelling.observed(words).reshape(2, -1)
        return spelling.fitted_to(spelling.tried(words))

    @classmethod
    def empty(cls, characters: np.ndarray) -> Spelling:
        code = Code(np.concatenate([characters[:256] + 1, [max(1, characters[256])]]))
        return cls(code, {}, np.zeros((2, 1 << cls.BITS), np.int64), np.array([1.0, 0.0, 0.0, 0.0]))

    @staticmethod
    def characters(words: list[bytes] | pa.Array) -> np.ndarray:
        """How often each byte stands in the words, and how many words there are."""
        return np.append(np.bincount(_bytes(words)[0], minlength=256), len(words)).astype(np.int64)

    def observed(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """How many bits each cell has had, and how many of them were ones; adds up over words."""
        out = np.zeros((2, 1 << self.BITS), np.int64)
        for at in range(0, len(words), WORDS):
            cells, places, _ = self._cells(words[at : at + WORDS])
            ones = self._true.take(places).astype(np.int64) << self.BITS
            out += np.bincount(np.concatenate([cell | ones for cell in cells]), minlength=2 << self.BITS).reshape(2, -1)
        out[0] += out[1]
        return out.ravel()

    def tried(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """How many bits of words that the table has seen have which inputs, in favour of what is true and rounded, when each
        bit's own part in the table is left out; adds up over words."""
        out = np.zeros(int(np.prod(self._SHAPE)), np.int64)
        first = self._rounded(self.code.stretched.astype(np.float64), 0) * int(np.prod(self._SHAPE[1:]))
        for at in range(0, len(words), WORDS):
            cells, places, _ = self._cells(words[at : at + WORDS])
            ones, cell = self._true.take(places).astype(np.int64) << self.BITS, first.take(places)
            for k, c in enumerate(cells, 1):
                cell += self._left.take(c | ones).astype(np.int64) * int(np.prod(self._SHAPE[k + 1 :]))
            out += np.bincount(cell, minlength=len(out))
        return out

    #: Inputs are rounded to so many values, in steps of one for the first and of a half for the others, around 0.
    _SHAPE = (17, 25, 25, 25)

    def _rounded(self, x: np.ndarray, k: int) -> np.ndarray:
        reach = self._SHAPE[k] // 2
        return np.clip(np.rint(x * (2 if k else 1)), -reach, reach).astype(np.int64) + reach

    @cached_property
    def _left(self) -> np.ndarray:
        """The rounded input of each cell for a zero of its own, then for a one, that is left out."""
        out = []
        for true, sign in ((0, -1.0), (1, 1.0)):
            ones = self.table[1] - true
            seen = (ones >= 0) & (self.table[0] - 1 - ones >= 0)  # others aren't asked for
            x = np.log((np.where(seen, ones, 0) + 0.3) / (np.where(seen, self.table[0] - 1 - ones, 0) + 0.3))
            out.append(self._rounded(x * sign, 1).astype(np.int8))
        return np.concatenate(out)

    def fitted_to(self, tried: np.ndarray) -> Spelling:
        """Weights by logistic regression over all that was tried; without any, those of an empty table."""
        cells = np.flatnonzero(tried)
        if not len(cells):
            return self
        n, places = tried[cells].astype(np.float64), np.unravel_index(cells, self._SHAPE)
        signed = np.array([(p - size // 2) / (2 if k else 1) for k, (p, size) in enumerate(zip(places, self._SHAPE, strict=True))])
        w = np.full(4, 0.3)
        for _ in range(20):
            p = 1 / (1 + np.exp(-np.clip(w @ signed, -30, 30)))
            step = np.linalg.solve((signed * (n * p * (1 - p))) @ signed.T + 1e-3 * np.eye(4), signed @ (n * (1 - p)))
            w = w + np.clip(step, -0.5, 0.5)
        return Spelling(self.code, self.alphabet, self.table, w)

    @cached_property
    def _depths(self) -> np.ndarray:
        """The depth of each place in ``code.stretched``."""
        return np.arange(len(self.code.stretched)) - np.repeat(self.code.offsets, self.code.lengths)

    @cached_property
    def _nodes(self) -> np.ndarray:
        """A number for the node of each place: the bits before it and how many they are."""
        shift = (WIDTH - self._depths).astype(np.uint64)
        return (np.repeat(self.code.codes, self.code.lengths) >> shift) + (self._depths.astype(np.uint64) << np.uint64(50))

    @cached_property
    def _true(self) -> np.ndarray:
        """Whether the bit at each place is a one."""
        shift = (WIDTH - self._depths - 1).astype(np.uint64)
        return (np.repeat(self.code.codes, self.code.lengths) >> shift & np.uint64(1)).astype(bool)

    def _cells(self, words: list[bytes] | pa.Array):
        """For each bit of each word's characters and end: cells of the contexts, and its place in ``code.stretched``; and
        the first bit of each word."""
        data, lengths = _bytes(words)
        ends = np.cumsum(lengths + 1)
        starts = ends - lengths - 1
        joined = np.full(len(data) + len(lengths), 256, np.int64)
        inside = np.ones(len(joined), bool)
        inside[ends - 1] = False
        joined[inside] = data
        place = np.arange(len(joined)) - np.repeat(starts, lengths + 1)
        sizes = self.code.lengths.take(joined)
        upto = np.cumsum(sizes)
        first = upto - sizes
        places = np.arange(int(upto[-1]))
        places += np.repeat(self.code.offsets.take(joined) - first, sizes)
        node = self._nodes.take(places)
        cells, context = [], np.zeros(len(joined), np.uint64)
        for k in range(1, 5):
            before = np.where(place >= k, np.roll(joined, k), 257).astype(np.uint64)
            context = mixed(context * np.uint64(1021) + before + np.uint64(k))
            if k > 1:
                hashed = mixed(np.repeat(context, sizes) + node)
                hashed >>= np.uint64(64 - self.BITS)
                cells.append(hashed.view(np.int64))
        return cells, places, first.take(starts)

    @cached_property
    def _logits(self) -> np.ndarray:
        return np.log((self.table[1] + 0.3) / (self.table[0] - self.table[1] + 0.3))

    def bits(self, words: list[bytes] | pa.Array) -> np.ndarray:
        out, sign = np.zeros(len(words)), np.where(self._true, 1.0, -1.0)
        first = self.code.stretched * self.weights[0]
        for at in range(0, len(words), WORDS):
            cells, places, starts = self._cells(words[at : at + WORDS])
            z = self._logits.take(cells[0]) * self.weights[1]
            for w, cell in zip(self.weights[2:], cells[1:], strict=True):
                z += self._logits.take(cell) * w
            z *= sign.take(places)
            z += first.take(places)
            out[at : at + WORDS] = np.add.reduceat(np.logaddexp(0, -z), starts) / np.log(2)
        return out


def _bytes(words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words in a row, and how many each has."""
    if isinstance(words, list):
        words = pa.array(words, pa.binary())
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, np.diff(offsets)
