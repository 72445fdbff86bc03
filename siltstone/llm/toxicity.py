"""Toxicity: noisy-channel deobfuscation by Viterbi under a character language model, then a score of the restored words."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chars, common, words

#: Bounds of the labelled training sample; lengths of word beginnings; score from which a document is predicted toxic.
TOXIC, CLEAN, STEMS, BAD = 4000, 6000, (4, 5, 6, 7, 8, 9, 10), 0.7
#: Symbols of the language model: 0 is a word's end, then a to z, then U+00DF to U+00FF, then any other letter.
SYMBOLS = 1 + 26 + 33 + 1
#: Channel: what a character may stand for, and costs in nats of a substitution, a dropped accent, a dropped third or later repeat, a dropped second one, a dropped separator,
#: a dropped loose separator, a dropped mark and a break.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
SUBSTITUTE, ACCENT, REPEAT, DOUBLE, GAP, LOOSE_GAP, DROP, BREAK = 1.0, 2.0, 0.3, 2.5, 0.2, 1.5, 14.0, 5.0
#: Separators that hide words, separators that also part words as a rule, and what doesn't show at all (combining marks too).
SEPARATORS, LOOSE, HIDDEN = " .-_*", "/,:;~'\"\\^=()", "\u00ad\u200b\u200c\u200d\u2060\ufeff" + "".join(map(chr, range(0x300, 0x370)))
#: Letters of other scripts that look like a letter of a to z; blocks that hold letters with accents, wide and styled ones; characters between the pieces of a word at most.
TWINS = dict(zip("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0455\u0458\u0501\u03bf", "aeopcyxisjdo"))
DRESSED, WIDEST = ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF21, 0xFF5B), (0x1D400, 0x1D6A4)), 3
#: Marks that also stand for the last letter of a word; decoded spans that a worker keeps.
FINAL, KEPT = "$@+|", 20_000
STEP = 0x9E3779B97F4A7C15


def _symbol_table() -> np.ndarray:
    letter, lower, _ = chars.tables()
    own = np.where(letter, SYMBOLS - 1, 0).astype(np.uint8)
    own[97:123] = np.arange(1, 27)
    own[0xDF:0x100] = np.arange(27, 60)
    own[0xF7] = 0
    return own[lower]


@cache
def plain(c: str) -> str:
    """The letter of a to z that a letter with accents, a wide or a styled one is made from; else nothing."""
    first, *rest = unicodedata.normalize("NFKD", c)
    first = first.lower()
    return first if first != c and "a" <= first <= "z" and all(unicodedata.combining(x) for x in rest) else ""


@cache
def _gates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: may it stand between the letters of a word, does a letter wear accents or styles, is it a twin of another script?"""
    gap, dressed, twin = (np.zeros(chars.POINTS, bool) for _ in range(3))
    gap[[ord(c) for c in SEPARATORS + LOOSE + HIDDEN]] = True
    for a, b in DRESSED:
        dressed[a:b] = [chr(p).isalpha() and bool(plain(chr(p).lower()) or plain(chr(p))) for p in range(a, b)]
    twin[[ord(x) for c in TWINS for x in (c, c.upper())]] = True
    return gap, dressed, twin


_MARKED, _BETWEEN, _RUN = re.compile(f"[{re.escape(''.join(LEET))}]"), re.compile(f"[{re.escape(SEPARATORS + LOOSE + HIDDEN)}]+"), re.compile(r"(.)\1+", re.S)


def skeleton(span: str) -> str:
    """A span without what stands between letters, accents and repeats. Any word that a span without look-alike digits and marks
    decodes to has a skeleton that is a part of the span's."""
    bare = _BETWEEN.sub("", span)
    return _RUN.sub(r"\1", bare if bare.isascii() else "".join(c if c < "\x80" else TWINS.get(c) or plain(c) or c for c in bare))


def symbol(c: str) -> int:
    p = ord(c)
    return p - 96 if 97 <= p < 123 else p - 0xDF + 27 if 0xDF <= p < 0x100 and p != 0xF7 else SYMBOLS - 1 if c.isalpha() else 0


def train_characters(docs: DataFrame) -> np.ndarray:
    """-log P(symbol | the two before), from trigram counts over all texts. SYMBOLS ** 3 rows at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _symbol_table()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = words.utf8(batch.column(0))
            for lo, hi in words.runs(offsets, 1 << 19):
                own, at = chars.points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                s = np.insert(table[own], np.repeat(at, 2), 0).astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["gram", "k"])

    common.arrow_batches(docs.sparkSession)
    got = docs.where("text is not null").select("text").mapInArrow(count, "gram int, k bigint").groupBy("gram").agg(F.sum("k").alias("k")).toPandas()
    k = np.zeros(SYMBOLS**3)
    k[got["gram"].to_numpy(int)] = got["k"]
    k = k.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pair = k.sum(axis=0)
    back = (pair + 0.1) / (pair.sum(axis=1, keepdims=True) + 0.1 * SYMBOLS)
    return -np.log((k + 2 * back) / (k.sum(axis=2, keepdims=True) + 2)).astype(np.float32)


class Decoder:
    """Restores obfuscated spans; keeps what it has decoded."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.reshape(-1, SYMBOLS).tolist()
        self.seen: dict[tuple[str, float], tuple[str, tuple[str, ...]]] = {}

    def decode(self, span: str) -> str:
        """The words, separated by spaces, on the cheapest path of the span's lattice."""
        return self.gained(span)[0]

    def gained(self, span: str, parting: float = BREAK) -> tuple[str, tuple[str, ...]]:
        """The decoded span and those of its words that don't stand in it as it is. A separator costs `parting` where it parts
        words: 0 if the span is ordinary words, so that they are joined only where the language model gains by it."""
        if (got := self.seen.get((span, parting))) is None:
            if len(self.seen) >= KEPT:
                self.seen.clear()
            found = self._path(span, parting).split()
            got = self.seen[span, parting] = " ".join(found), tuple(w for w in found if w not in span)
        return got

    @staticmethod
    def options(span: str, i: int, parting: float = BREAK) -> list[tuple[str, float]]:
        """What the i-th character may stand for ("" for nothing) and what that costs; all tricks may meet in one span."""
        return [(out, price) for out, _, price in _outputs(span[i], _again(span, i), parting)]

    def step(self, a: int, b: int, s: int) -> float:
        """The language model's cost of symbol s after a and b; a second end of word costs nothing."""
        return self.cost[a * SYMBOLS + b][s] if s or b else 0.0

    def _path(self, span: str, parting: float = BREAK) -> str:
        # A path is (path before, symbol), so that paths share what they have in common and the cost stays linear. A state is its last two symbols.
        cost, states = self.cost, {0: (0.0, None)}
        span += "\n"
        for i, c in enumerate(span):
            options = _outputs(c, _again(span, i), parting)
            new: dict[int, tuple[float, tuple | None]] = {}
            for state, (total, path) in states.items():
                b = state % SYMBOLS
                for out, s, price in options:
                    key, own = (b * SYMBOLS + s, total + price + (cost[state][s] if s or b else 0.0)) if out else (state, total + price)
                    if key not in new or own < new[key][0]:
                        new[key] = own, (path, out) if out else path
            states = new
        path = min(states.values(), key=lambda x: x[0])[1]
        out = []
        while path is not None:
            path, c = path
            out.append(c)
        return "".join(reversed(out))


def _again(span: str, i: int) -> int:
    """0: another character than the one before; 1: the second of two equal ones; 2: one of three or more."""
    c = span[i]
    return 0 if not i or span[i - 1] != c else 2 if span[i + 1 : i + 2] == c or i > 1 and span[i - 2] == c else 1


@cache
def _outputs(c: str, again: int, parting: float) -> list[tuple[str, int, float]]:
    """(What a character may stand for, its symbol, the cost)."""
    out: list[tuple[str, float]] = []
    if again and (c.isalpha() or c in LEET):
        out = [("", REPEAT if again == 2 else DOUBLE)]
    if c in LEET:
        out += [(x, SUBSTITUTE) for x in LEET[c]] + [("", DROP), (" ", DROP if c.isdigit() else BREAK)]
    elif c.isalpha():
        base = "" if c < "\x80" else TWINS.get(c) or plain(c)
        if base and unicodedata.decomposition(c).startswith("<"):
            out.append((base, 0.0))
        else:
            out += [(c, 0.0), (base, SUBSTITUTE if c in TWINS else ACCENT)] if base else [(c, 0.0)]
    elif c in SEPARATORS:
        out += [("", GAP), (" ", parting)]
    elif c in LOOSE:
        out += [("", LOOSE_GAP), (" ", 0.0)]
    elif c in HIDDEN:
        out.append(("", 0.0))
    else:
        out.append((" ", 0.0))
    return [(x, symbol(x) if x else 0, price) for x, price in out]


def suspicious(own: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, begin, end) of the spans whose lattice has more than one path: words with look-alike digits or marks among
    their letters, of three or more look-alike marks, with a doubled letter, a separator or something hidden between letters, a letter with accents, a
    wide or styled letter or one of another script; and three or more single letters or look-alikes with up to WIDEST separators between each two.
    What such a span means is for the language model to say."""
    letter, lower, _ = chars.tables()
    n = len(own)
    if n < 3:
        return []
    is_letter, low = letter[own], lower[own]
    row_start = np.zeros(n + 1, bool)
    row_start[at] = True
    left = np.append(False, is_letter[:-1]) & ~row_start[:-1]
    right = np.append(is_letter[1:], False) & ~row_start[1:]
    point = np.minimum(own, 127)
    both, mark = (np.zeros(128, bool) for _ in range(2))
    both[[ord(c) for c in LEET if c.isdigit() or c in FINAL]] = True
    mark[[ord(c) for c in LEET if not c.isdigit() and c not in FINAL]] = True
    gap, dressed, twin = _gates()
    between = gap[own]
    hit = both[point] & (left | right) | mark[point] & right
    twice = np.append(False, is_letter[1:] & (low[1:] == low[:-1])) & ~row_start[:-1]
    hit |= twice | between & left & right & (own > 32) | dressed[own]
    basic = own < 0x80
    hit |= twin[own] & (left & np.append(False, basic[:-1]) | right & np.append(basic[1:], False))
    shown = ~between | (own < 0x80)
    hit |= ~shown & (np.append(False, ~shown[:-1]) | left) & (np.append(~shown[1:], False) | right)
    sign = (both | mark)[point] & ~((own >= 48) & (own < 58))
    only = sign[2:] & sign[1:-1] & sign[:-2] & ((own[2:] != own[1:-1]) | (own[1:-1] != own[:-2]))
    hit[1:-1] |= only & ~row_start[1:-2] & ~row_start[2:-1]
    symbols = is_letter | (both | mark)[point]
    single = symbols & ~np.append(False, symbols[:-1] & ~row_start[1:-1]) & ~np.append(symbols[1:] & ~row_start[1:-1], False)
    spaced = np.zeros(n, bool)
    alone = np.flatnonzero(single)
    if len(alone) >= 3:
        far = alone[1:] - alone[:-1]
        line, gaps = np.cumsum(row_start[:-1]), np.append(0, np.cumsum(between))
        near = (far <= WIDEST + 1) & (gaps[alone[1:]] - gaps[alone[:-1] + 1] == far - 1) & (line[alone[1:]] == line[alone[:-1]])
        three = np.flatnonzero(near[1:] & near[:-1] & (is_letter[alone[:-2]] | is_letter[alone[1:-1]] | is_letter[alone[2:]]))
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, alone[three], 1)
        np.add.at(edge, alone[three + 2] + 1, -1)
        spaced = np.cumsum(edge[:-1]) > 0
    space = own <= 32
    inside = ~space & ~spaced
    out = []
    if hit.any():
        begins = np.flatnonzero(inside & (np.append(True, ~inside[:-1]) | row_start[:-1]))
        ends = np.flatnonzero(inside & (np.append(~inside[1:], True) | row_start[1:])) + 1
        k = np.unique(np.searchsorted(begins, np.flatnonzero(hit & inside), side="right") - 1)
        out += list(zip(begins[k].tolist(), ends[k].tolist()))
    if spaced.any():
        begins = np.flatnonzero(spaced & (np.append(True, ~spaced[:-1]) | row_start[:-1]))
        ends = np.flatnonzero(spaced & (np.append(~spaced[1:], True) | row_start[1:])) + 1
        out += list(zip(begins.tolist(), ends.tolist()))
    out.sort()
    rows = np.searchsorted(at, [b for b, _ in out], side="right") - 1
    return [(int(r), b, e) for r, (b, e) in zip(rows, out)]


def _text(points: np.ndarray) -> str:
    _, lower, _ = chars.tables()
    return lower[points].astype(np.uint32).tobytes().decode("utf-32-le")


def _key(word: str, whole: bool) -> int:
    """The hash of a word's beginning (of STEMS letters) or of a whole word."""
    h = sum((ord(c) * 2 + 1) * pow(STEP, i, 1 << 64) for i, c in enumerate(word)) & (1 << 64) - 1
    return h ^ (2 * len(word) + whole)


class Lexicon:
    """Word beginnings ("idio") and whole words ("idiot$") with the probability that a document holding one is toxic."""

    def __init__(self, odds: dict[str, float], base: float):
        self.odds, self.base = odds, base
        stems = {w: p for w, p in odds.items() if not w.endswith("$")}
        full = {w[:-1]: p for w, p in odds.items() if w.endswith("$")}
        self.stems = {k: self._sorted({_key(w, False): p for w, p in stems.items() if len(w) == k}) for k in STEMS}
        self.full = self._sorted({_key(w, True): p for w, p in full.items()})
        self.longest = max((len(w) for w in full), default=0)
        self.begun = [np.array(sorted({_key(w[:k], False) for w in full if len(w) >= k}), np.uint64) for k in range(1, self.longest + 1)]

    @staticmethod
    def _sorted(table: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(sorted(table), np.uint64)
        return keys, np.array([table[int(k)] for k in keys])

    def of_word(self, word: str) -> float:
        return max([self.odds.get(word + "$", 0.0), *(self.odds.get(word[:k], 0.0) for k in STEMS if len(word) > k)])

    def of_words(self, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word found in the lexicon, its probability); words are runs of letters in lower case."""
        letter, lower, _ = chars.tables()
        is_letter = letter[own]
        begun = is_letter & ~np.append(False, is_letter[:-1])
        edge = at[:-1][at[:-1] < len(own)]
        begun[edge] = is_letter[edge]
        first = np.flatnonzero(begun)
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0)
        stop = ~is_letter | begun
        gaps = np.append(np.flatnonzero(stop), len(own))
        end = gaps[np.searchsorted(gaps, first, side="right")]
        size = end - first
        best = np.zeros(len(first))
        h = np.zeros(len(first), np.uint64)
        code = lower[own].astype(np.uint64) * np.uint64(2) + np.uint64(1)
        longest = max([*STEMS, *(len(w) - 1 for w in self.odds if w.endswith("$"))])
        power = 1
        at_word = np.arange(len(first))
        for k in range(longest):
            at_word = at_word[size[at_word] > k]
            h[at_word] += code[first[at_word] + k] * np.uint64(power)
            power = power * STEP & (1 << 64) - 1
            done = at_word[size[at_word] == k + 1]
            self._take(best, h, done, self.full, 2 * (k + 1) + 1)
            if k + 1 in self.stems:
                self._take(best, h, at_word[size[at_word] > k + 1], self.stems[k + 1], 2 * (k + 1))
        found = np.flatnonzero(best)
        return np.searchsorted(at, first[found], side="right") - 1, best[found]

    def reach(self) -> Callable[[str], bool]:
        """Tells whether the lattice of a span can hold a word of the lexicon: so where it says no, decoding can't change a score."""
        roots = ahocorasick.Automaton()
        for root in {skeleton(w.rstrip("$")) for w in self.odds}:
            roots.add_word(root, root)
        roots.make_automaton()
        return lru_cache(KEPT)(lambda span: bool(_MARKED.search(span)) or len(roots) > 0 and next(roots.iter(skeleton(span)), None) is not None)

    def across(self, own: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, begin, end) of neighbouring words that make a word of the lexicon if the separators between them are left out."""
        letter, lower, _ = chars.tables()
        place = np.flatnonzero(letter[own])
        if len(place) < 2 or not self.longest:
            return []
        gap, row = _gates()[0], np.searchsorted(at, place, side="right") - 1
        gaps, far = np.append(0, np.cumsum(gap[own])), np.append(WIDEST + 2, place[1:] - place[:-1])
        parted = far > 1
        parted[1:] |= row[1:] != row[:-1]
        joins = far <= WIDEST + 1
        joins[1:] &= (gaps[place[1:]] - gaps[place[:-1] + 1] == far[1:] - 1) & (row[1:] == row[:-1])
        code = lower[own[place]].astype(np.uint64) * np.uint64(2) + np.uint64(1)
        first = np.flatnonzero(parted)
        h, crossed, power, out = np.zeros(len(first), np.uint64), np.zeros(len(first), bool), 1, []
        for k in range(self.longest):
            stays = first + k < len(place)
            first, h, crossed = first[stays], h[stays], crossed[stays]
            now = first + k
            if k:
                stays = joins[now]
                first, h, crossed, now = first[stays], h[stays], crossed[stays] | parted[now[stays]], now[stays]
            h = h + code[now] * np.uint64(power)
            power = power * STEP & (1 << 64) - 1
            table = self.begun[k]
            own_key = h ^ np.uint64(2 * (k + 1))
            stays = table[np.minimum(np.searchsorted(table, own_key), len(table) - 1)] == own_key
            first, h, crossed, now = first[stays], h[stays], crossed[stays], now[stays]
            ends = crossed & np.append(parted, True)[now + 1]
            whole = h ^ np.uint64(2 * (k + 1) + 1)
            keys = self.full[0]
            ends &= keys[np.minimum(np.searchsorted(keys, whole), len(keys) - 1)] == whole
            out += zip(row[first[ends]].tolist(), place[first[ends]].tolist(), (place[now[ends]] + 1).tolist())
        return sorted(out)

    @staticmethod
    def _take(best: np.ndarray, h: np.ndarray, k: np.ndarray, table: tuple[np.ndarray, np.ndarray], salt: int) -> None:
        keys, odds = table
        if len(keys) and len(k):
            own = h[k] ^ np.uint64(salt)
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[i] == own
            best[k[hit]] = np.maximum(best[k[hit]], odds[i[hit]])


def _restored_words(own: np.ndarray, at: np.ndarray, decoder: Decoder) -> Iterator[set[str]]:
    """The words of each row, as they stand and as its spans decode."""
    low, spans, k = _text(own), suspicious(own, at), 0
    for row in range(len(at) - 1):
        found = set("".join(c if c.isalpha() else " " for c in low[at[row] : at[row + 1]]).split())
        while k < len(spans) and spans[k][0] == row:
            _, b, e = spans[k]
            found.update(decoder.gained(low[b:e])[1])
            k += 1
        yield found


def train_lexicon(docs: DataFrame, labels: DataFrame, cost: np.ndarray, toxic: int = TOXIC, clean: int = CLEAN) -> Lexicon:
    """Learns word beginnings and words that mark toxic documents, from at most `toxic` and `clean` labelled documents.

    docs and labels hold training rows only. Copies are thinned first: of documents with the same least hash of word
    pairs one stays (the one of the least features, so reruns agree). What comes to the driver is bounded by the sample: features that
    stand in `support` (4 or more) of the toxic documents and nearly nowhere else. A feature counts if it stands in many documents of which nearly all are toxic; a beginning only if it
    gives notably more of them than each longer beginning of it. Without toxic labels nothing is toxic.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_bad, n_good = known.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    pick = lambda kind, most: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = pick(1, toxic).unionByName(pick(0, clean))
    sample = docs.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(ids), "doc_id")  # toxic + clean ids at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(cost)
        for batch in batches:
            out = []
            data, offsets = words.utf8(batch.column(1))
            for lo, hi in words.runs(offsets, 1 << 19):
                own, at = chars.points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for row, held in enumerate(_restored_words(own, at, decoder), lo):
                    raw = data[offsets[row] : offsets[row + 1]]
                    h, _, _ = words.word_hashes(raw, np.array([0, len(raw)]))
                    pairs = words.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h
                    out.append((int(pairs.view(np.int64).min()) if len(pairs) else 0, sorted({w[:k] for w in held for k in STEMS if len(w) > k} | {w + "$" for w in held if len(w) >= 3})))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.string()))], ["toxic", "sig", "f"])

    common.arrow_batches(spark)
    seen = common.settle(sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(emit, "toxic int, sig bigint, f array<string>"))
    seen = seen.groupBy("sig", "toxic").agg(F.min("f").alias("f"))
    seen = common.settle(seen)
    bad, good = seen.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    base = (n_bad + 0.5) / (n_bad + n_good + 1)
    if not bad:
        return Lexicon({}, min(base, 0.5))
    support = max(4, min(12, bad // 100))
    weigh = (n_good / max(1, good)) / (n_bad / max(1, bad))
    by = seen.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    rows = by.where((F.col("bad") >= support) & (F.col("good") * (4 * weigh) <= F.col("bad"))).collect()
    count = {r["f"]: (r["bad"], r["good"]) for r in rows}
    covered: dict[str, int] = {}
    for f, (k, _) in count.items():
        for n in STEMS:
            if n < len(f.rstrip("$")) or n == len(f) - 1 and f.endswith("$"):
                covered[f[:n]] = max(covered.get(f[:n], 0), k)
    odds = {f: (k + 0.5) / (k + 0.5 + weigh * (c + 0.1)) for f, (k, c) in count.items() if k >= 1.2 * covered.get(f, 0)}
    return Lexicon({f: p for f, p in odds.items() if p >= 0.5}, min(base, 0.5))


def score_toxicity(docs: DataFrame, cost: np.ndarray, lexicon: Lexicon, threshold: float = BAD) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic), predicted (1 from `threshold` on) and restored (decoded spans).

    Every word and every word of a decoded span is looked up, and neighbouring words that make a word of the lexicon are decoded as well (the language model
    may leave them as they are). `restored` names the spans that decoding changes (spans whose lattice can't hold a word of the lexicon need no decoding); the score is the chance that at least one of those
    found marks a toxic document, as if they were independent. Null and empty texts, and texts without a known word,
    score a tenth of the share of toxic labels. Equal texts score alike. An empty table gives an empty table; columns with the new names are
    replaced.
    """

    @F.arrow_udf("struct<score:double,restored:array<string>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder, reach = Decoder(cost), lexicon.reach()
        for batch in batches:
            data, offsets = words.utf8(batch)
            clear = np.zeros(len(batch))
            restored: list[list[str]] = [[] for _ in range(len(batch))]
            for lo, hi in words.runs(offsets, 1 << 19):
                own, at = chars.points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, p = lexicon.of_words(own, at)
                np.add.at(clear, lo + row, np.log1p(-np.minimum(p, 0.999)))
                low, spans = _text(own), suspicious(own, at)
                begins, ends = [b for _, b, _ in spans], [e for _, _, e in spans]
                inside = lambda b, e: (k := bisect_right(begins, b)) and ends[k - 1] >= e
                joined = [(r, b, e, 0.0) for r, b, e in lexicon.across(own, at) if not inside(b, e)]
                for r, b, e, parting in [*((*x, BREAK) for x in spans), *joined]:
                    raw = low[b:e]
                    if not reach(raw):
                        continue
                    text, gained = decoder.gained(raw, parting)
                    if gained:
                        restored[lo + r].append(f"{raw} > {text}")
                    for word in gained:
                        if p := lexicon.of_word(word):
                            clear[lo + r] += np.log1p(-min(p, 0.999))
            score = 1 - (1 - 0.1 * lexicon.base) * np.exp(clear)
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(restored, pa.list_(pa.string()))], ["score", "restored"])

    common.arrow_batches(docs.sparkSession)
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted", "restored")])
    own = common.fresh("found", kept.columns)
    found = kept.withColumn(own, scored(F.coalesce("text", F.lit(""))))
    return found.select(*kept.columns, f"{own}.score", (F.col(f"{own}.score") >= threshold).cast("int").alias("predicted"), f"{own}.restored")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(common.fold("doc_id", 3) == 1, F.lit(False))
    cost = train_characters(docs)
    learn = ~held & F.col("doc_id").isNotNull()
    lexicon = train_lexicon(docs.where(learn), common.table(spark, sf_dir, "labels").where(learn), cost)
    out = score_toxicity(docs, cost, lexicon).withColumn("held_out", held)
    return out.select("doc_id", "held_out", "score", "predicted", F.size("restored").alias("n_restored"))
