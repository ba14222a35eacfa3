"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with a CRF that finds what is written in other ways.

The patterns give the base spans of e-mail addresses, IP addresses, card and phone numbers. The net (``tagger.py``) is trained on labelled spans: the base spans of a bounded sample of
documents, and spans put into other snippets of these documents, as the patterns have them or spelled otherwise (``name (at) host dot com``, phone numbers without a country, cards with dots,
addresses of version six), beside things that only look alike (dates, times, versions, amounts, digests, plain numbers).

Every text is read whole, in windows of WINDOW characters that overlap by two margins. Each window is decoded; a character's tag comes from the window in which it stands farthest from an edge, the tags of a text are put
together to one sequence and spans are taken from that, so one that a window's edge cuts is whole again, whatever its length. The net runs on the windows in which a stretch of LONGEST characters may have what its kind can't be without (``may_hold``), and
on the next one where a run of tags reaches a window's edge; elsewhere none of its spans could count, so the spans are those of all windows. Spans that overlap a base span, are very short or long, lack what their kind can't be without, or win by little against no tag are dropped: base spans stay as they are.

Each pattern is matched in linear time (for instance from its ``@`` backwards), as texts may be one run of millions of letters; tests hold them against the plain expressions.

Cases: null text is empty text and has no spans; positions are code points, ends exclusive; spans of different kinds may overlap, of one kind never; equal texts have equal spans; rows that repeat a doc_id are each
answered; an empty table gives no rows and trains nothing; other columns are ignored by ``find`` and ``digests`` and kept by ``redacted``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import parts, tidy, with_text
from placemill.llm.tagger import KINDS, Net, chars_in, classes, decode, scores, trained

Span = tuple[str, int, int]

#: Documents from which labelled snippets are taken, those of least hash; and snippets with and without spans that are kept of them.
FIT_ROWS = 20_000
FIT_SNIPPETS = 2_000
SNIPPET = 96
#: Labelled snippets that are made of them, and how the net is trained.
FIT_MADE = 6_000
HIDDEN, STEPS, BATCH, SEED = 8, 600, 128, 11
#: Characters of a window, of its margin on either side, and windows that are decoded together.
WINDOW, MARGIN, TOGETHER = 768, 32, 1024
#: A span of the net has so many characters and leads against no tag by at least so much.
SHORTEST, LONGEST, LEAD = 7, 80, 6.0

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]++")


def emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in _AT.finditer(text):
        at = start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = m.end()
            yield start, last


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Of a chain of numbers, each four in turn."""
    for m in _DOTTED.finditer(text):
        at, numbers = m.start(), m.group().split(".")
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PLUS.finditer(text):
        found = m.group().rstrip(" ().-")
        if len(found) > 3 and 9 <= sum(c.isdigit() for c in found) <= 15:
            yield m.start(), m.start() + len(found)


def base_spans(text: str) -> list[Span]:
    """By start, then by kind as listed."""
    found = [(kind, *at) for kind, fn in zip(KINDS, (emails, ips, cards, phones), strict=True) for at in fn(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# Labelled spans


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, low: int = 2, high: int = 9) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(low, high)))


def _card(rng: np.random.Generator) -> str:
    first = _digits(rng, 15)
    return next(first + str(k) for k in range(10) if luhn(first + str(k)))


def _one(rng: np.random.Generator, *of: str) -> str:
    return of[rng.integers(0, len(of))]


def _host(rng: np.random.Generator) -> list[str]:
    return [_word(rng, 3, 9) + _one(rng, "", _digits(rng, 1)), *([_word(rng, 3, 7)] * int(rng.random() < 0.2)), _one(rng, "com", "net", "org", "test", "example", "de", "fr", "io")]


def made_span(rng: np.random.Generator, kind: str) -> str:
    """A span of a kind, as its pattern has it or otherwise."""
    if kind == "email":
        name = _word(rng) + _one(rng, "", ".", "_") + _word(rng) + _one(rng, "", _digits(rng, 2))
        at, dot = (("@", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" @ ", "."), (" AT ", " DOT "))[rng.integers(0, 8)]
        return name + at + dot.join(_host(rng))
    if kind == "ip":
        if rng.random() < 0.4:
            return ":".join(f"{rng.integers(0, 1 << 16):x}" for _ in range(8))
        return _one(rng, ".", ".", "[.]", " . ").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        digits = _card(rng)
        return _one(rng, " ", "-", "", ".", "/").join(digits[k : k + 4] for k in range(0, 16, 4))
    head = _one(rng, f"+{rng.integers(1, 99)} ", "+1 ", "", "", "00", "tel:")
    tail = _one(rng, f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}", f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}", f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 4)}", f"{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}")
    return head + tail


def look_alike(rng: np.random.Generator) -> str:
    """What is no personal data."""
    n = lambda low, high: str(rng.integers(low, high))
    return _one(
        rng, f"{n(1900, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 29)}.{n(1, 13)}.{n(1990, 2030)}", f"{n(10, 24)}:{n(10, 60)}:{n(10, 60)}", f"v{n(0, 20)}.{n(0, 30)}.{n(0, 9)}", f"{n(1, 999)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"${n(1, 9999)}.{_digits(rng, 2)}",
        f"{n(1, 99)}%", _digits(rng, int(rng.integers(1, 9))), _digits(rng, int(rng.integers(20, 30))), "".join(rng.choice(list("0123456789abcdef"), rng.integers(16, 64))), "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), rng.integers(12, 40))),
        f"https://{'.'.join(_host(rng))}/{_word(rng)}?{_word(rng)}={n(1, 99)}", f"@{_word(rng)}", f"#{n(1, 99999)}", f"{n(1, 99)}-{n(1, 99)}", f"({n(1, 99)})", f"{_word(rng)}_{_word(rng)}: {n(1, 9)}", f" at {_word(rng)} ", f" dot {_word(rng)}", f"<{_word(rng)}>", f"{n(0, 9)}.{n(0, 9)}", f"{_word(rng)} at the {_word(rng)}.",
        f"{_one(rng, _word(rng), 'at', 'dot', 'to')}{_one(rng, ' ', '. ', ', ')}" * int(rng.integers(3, 12)),
    )


def snippet_batches(pool: list[str], made: int = FIT_MADE, size: int = BATCH, length: int = SNIPPET) -> Callable[[np.random.Generator], tuple[np.ndarray, np.ndarray]]:
    """Batches ``seen, truth`` of ``made`` labelled snippets: those of the pool with base spans as they are, most others with one or two insertions."""
    pool = pool or [" "]

    def drawn(rng: np.random.Generator, size: int) -> tuple[np.ndarray, np.ndarray]:
        seen, truth = np.zeros((length, size), np.uint8), np.zeros((length, size), np.int64)
        for k in range(size):
            text = pool[rng.integers(0, len(pool))]
            spans = base_spans(text)
            if not spans and rng.random() < 0.8:
                for _ in range(rng.integers(1, 3)):
                    kind = KINDS[rng.integers(0, len(KINDS))] if rng.random() < 0.5 else None
                    new = made_span(rng, kind) if kind else look_alike(rng)
                    free = [c for c in range(0, max(1, len(text) - len(new))) if c == 0 or text[c - 1].isspace()]
                    at = free[rng.integers(0, len(free))] if free else 0
                    if any(a < at + len(new) + 2 and at - 2 < b for _, a, b in spans):
                        continue
                    text = f"{text[:at]}{new}{' ' if at + len(new) < len(text) else ''}{text[at + len(new) + 1 :]}"
                    spans = [*spans, *([(kind, at, at + len(new))] if kind else base_spans(new) and [(s, at + a, at + b) for s, a, b in base_spans(new)])]
            found = classes(text[:length])
            seen[: len(found), k] = found
            seen[len(found) :, k] = classes(" ")[0]
            for kind, a, b in spans:
                truth[a:b, k] = KINDS.index(kind) + 1
        return seen, truth

    every = drawn(np.random.default_rng(SEED), made)

    def draw(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        some = rng.integers(0, made, size)
        return every[0][:, some], every[1][:, some]

    return draw


def snippets(docs: DataFrame, rows: int = FIT_ROWS, most: int = FIT_SNIPPETS) -> list[str]:
    """Snippets of ``rows`` documents at most: those with base spans, and the first and a middle one of each document; ``most`` of either sort, by hash."""
    total = docs.count()
    if total == 0:
        return []
    by = F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))
    share = min(1.0, 2 * rows / total)
    some = with_text(docs, "doc_id").select(by.alias("by"), "text").filter(F.pmod("by", F.lit(1 << 20)) < int(share * (1 << 20)))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, marked, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, a, b in base_spans(text)[:8]:
                    # where in the snippet the span stands follows from the row's key
                    at = max(0, a - key % max(1, SNIPPET - (b - a)))
                    texts.append(text[at : at + SNIPPET])
                    keys.append(key)
                    marked.append(True)
                for at in (0, len(text) // 2):
                    texts.append(text[at : at + SNIPPET])
                    keys.append(key)
                    marked.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(marked, pa.bool_()), pa.array(texts, pa.string())], names=["by", "marked", "snippet"])

    cut = some.mapInArrow(tidy(fn), "by long, marked boolean, snippet string").groupBy("marked", "snippet").agg(F.min("by").alias("by"))
    out = []
    for wanted in (True, False):
        out += [r.snippet for r in cut.filter(F.col("marked") == wanted).orderBy("by", "snippet").limit(most).collect()]
    return out


def holds(kind: str, piece: str) -> bool:
    """Whether a stretch has what its kind can't be without."""
    digits = re.sub(r"[^0-9]", "", piece)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", piece, re.I) and re.search(r"\.|\bdot\b", piece, re.I)) and len(set(re.findall(r"[a-z0-9]+", piece.lower()))) > 2
    if kind == "ip":
        four = re.findall(r"[0-9]+", piece)
        return piece.count(":") == 7 or len(four) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in four)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


_WORD = chars_in("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_DIGITS_, _COLONS, _STOPS, _SIGNS, _A, _D, _O, _T = (np.flatnonzero(chars_in(chars)) for chars in ("0123456789", ":", ".", "@", "aA", "dD", "oO", "tT"))


def _are(seen: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([seen == k for k in kinds])


def may_hold(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, each ascending, of the parts of a text, given by its classes, in which all stretches of LONGEST characters at most lie that may be ones that ``holds``."""
    digits, colons = np.flatnonzero(_are(seen, _DIGITS_)), np.flatnonzero(_are(seen, _COLONS))
    first = np.flatnonzero(np.diff(digits, prepend=-2) > 1)
    last = np.append(first[1:], len(digits))[: len(first)] - 1
    # a word "at", or one that a stretch may cut to it (what is not ASCII may end a word), with a stop or "dot" in reach
    a, d, o, t = (_are(seen, kinds) for kinds in (_A, _D, _O, _T))
    pairs = np.flatnonzero(a[:-1] & t[1:])
    whole = ~np.concatenate((_WORD[seen], [False, False]))  # at -1, too
    at = np.sort(np.concatenate((pairs[whole[pairs - 1] | whole[pairs + 2]], np.flatnonzero(_are(seen, _SIGNS)))))
    stops = np.sort(np.concatenate((np.flatnonzero(_are(seen, _STOPS)), np.flatnonzero(d[:-2] & o[1:-1] & t[2:]))))
    at = at[np.searchsorted(stops, at + LONGEST) > np.searchsorted(stops, at - LONGEST)]
    # seven digits, four groups of them, seven colons: the first and the last character that a stretch has to reach
    low = np.concatenate((digits[:-6], digits[last][:-3], colons[:-6], at))
    high = np.concatenate((digits[6:], digits[first][3:], colons[6:], at))
    close = high - low < LONGEST
    return np.sort(high[close]) + 1 - LONGEST, np.sort(low[close]) + LONGEST


# Windows


@dataclass(frozen=True)
class Finder:
    """The patterns and a trained net."""

    net: Net
    window: int = WINDOW
    margin: int = MARGIN
    lead: float = LEAD
    everywhere: bool = False

    def windows(self, length: int) -> list[tuple[int, int]]:
        """Starts and ends that cover a text, each but the last ``window`` long, two neighbours sharing two margins."""
        step = self.window - 2 * self.margin
        return [(at, min(at + self.window, length)) for at in range(0, max(1, length - 2 * self.margin), step)] if length else []

    def tags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text a tag a character, and what it has over no tag."""
        seen = [classes(t) for t in texts]
        out = [(np.zeros(len(s), np.uint8), np.zeros(len(s), np.float32)) for s in seen]
        every = [(k, a, b) for k, s in enumerate(seen) for a, b in self.windows(len(s))]
        own = np.array([self.own(a, b, len(seen[k])) for k, a, b in every], np.int64).reshape(-1, 2)
        # all texts in one row, with gaps that no stretch crosses
        gap = classes("|" * LONGEST)
        begins = np.cumsum([0, *(len(s) + LONGEST for s in seen)])[[k for k, *_ in every]] if every else np.zeros(0, np.int64)
        starts, ends = may_hold(np.concatenate([part for s in seen for part in (s, gap)] or [gap]))
        may = np.searchsorted(starts, begins + own[:, 1]) > np.searchsorted(ends, begins + own[:, 0], "right")
        now = [w for w, yes in zip(every, may | self.everywhere, strict=True) if yes]
        rest = [w for w, yes in zip(every, may | self.everywhere, strict=True) if not yes]
        while now:
            tagged = self._decoded(now, seen, out)
            now = [w for w in rest if w[0] in tagged and self._reached(out[w[0]][0], *w[1:])]
            taken = set(now)
            rest = [w for w in rest if w not in taken]
        return out

    def own(self, a: int, b: int, length: int) -> tuple[int, int]:
        """The characters of a text that take their tags from this window."""
        return a if a == 0 else a + self.margin, b if b == length else b - self.margin

    def _reached(self, tags: np.ndarray, a: int, b: int) -> bool:
        """Whether a run of tags ends where a window begins, or begins where it ends."""
        low, high = self.own(a, b, len(tags))
        return bool(low > 0 and tags[low - 1] or high < len(tags) and tags[high])

    def _decoded(self, every: list[tuple[int, int, int]], seen: list[np.ndarray], out: list[tuple[np.ndarray, np.ndarray]]) -> set[int]:
        """Puts the tags of windows into ``out``; the texts that have any."""
        tagged = set()
        every = sorted(((b - a, k, a, b) for k, a, b in every), reverse=True)
        for first in range(0, len(every), TOGETHER):
            some = every[first : first + TOGETHER]
            lengths = np.array([n for n, *_ in some])
            grid = np.zeros((lengths[0], len(some)), np.uint8)
            for lane, (n, k, a, b) in enumerate(some):
                grid[:n, lane] = seen[k][a:b]
            best, gain = decode(self.net, scores(self.net, grid, lengths), lengths)
            for lane in np.flatnonzero(best.any(axis=0)):
                _, k, a, b = some[lane]
                low, high = self.own(a, b, len(seen[k]))
                out[k][0][low:high] = best[low - a : high - a, lane]
                out[k][1][low:high] = gain[low - a : high - a, lane]
                tagged.add(k)
        return tagged

    def added(self, text: str, tags: np.ndarray, gain: np.ndarray, base: list[Span]) -> list[Span]:
        """The net's spans that count."""
        on = np.flatnonzero(tags)
        if not len(on):
            return []
        found = []
        for run in np.split(on, np.flatnonzero((np.diff(on) > 1) | (np.diff(tags[on].astype(np.int16)) != 0)) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            while a < b and not (text[a].isalnum() or text[a] in "+([<"):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if SHORTEST <= b - a <= LONGEST and holds(KINDS[tags[run[0]] - 1], text[a:b]) and float(gain[a:b].sum()) >= self.lead and not any(x < b and a < y for _, x, y in base):
                found.append((KINDS[tags[run[0]] - 1], a, b))
        return found

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Of each text the base spans and the net's."""
        tagged = self.tags(texts)
        bases = [base_spans(t) for t in texts]
        return [(base, self.added(t, *tag, base)) for t, tag, base in zip(texts, tagged, bases, strict=True)]


def fitted(docs: DataFrame, steps: int = STEPS) -> Finder:
    """A finder whose net is trained on snippets of ``docs``; the same rows give the same net."""
    pool = snippets(docs)
    return Finder(trained(snippet_batches(pool), HIDDEN, steps if pool else 0, SEED))


def _in_slices(fn: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1024, 1 << 21):
                yield fn(part, part.column(1).to_pylist())

    return tidy(run)


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """``doc_id, kind, start, stop, piece, base``: one row a span, ``base`` telling which the patterns found."""
    finder = finder or fitted(docs)
    shape = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("piece", pa.string()), ("base", pa.bool_())])

    def fn(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        rows = []
        for i, t, (base, more) in zip(part.column(0).to_pylist(), texts, finder.spans(texts), strict=True):
            rows += [{"doc_id": i, "kind": k, "start": a, "stop": b, "piece": t[a:b], "base": (k, a, b) in base} for k, a, b in _in_order(base + more)]
        return pa.RecordBatch.from_pylist(rows, shape)

    rows = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.mapInArrow(_in_slices(fn), "doc_id long, kind string, start long, stop long, piece string, base boolean")


def redacted(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """``docs`` with ``<KIND>`` for each stretch that spans cover, the first span naming it; all columns as they were."""
    finder = finder or fitted(docs)

    def clean(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for kind, a, b in spans:
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def fn(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        done = [clean(t, _in_order(base + more)) for t, (base, more) in zip(texts, finder.spans(texts), strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string())], names=["whole", "text"])

    rows = with_text(docs.select(F.struct("*").alias("whole"), "text"), "whole")
    out = rows.mapInArrow(_in_slices(fn), rows.schema)
    return out.select(*(F.col("text").alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns))


def digests(docs: DataFrame, finder: Finder | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, base spans of each kind, the digest of the base spans, all spans, and how many the net added."""
    finder = finder or fitted(docs)

    def fn(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        found = finder.spans(texts)
        counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
        shas = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
        every = pa.array([joined(_in_order(base + more)) for base, more in found])
        return pa.RecordBatch.from_arrays([part.column(0), *counts, shas, every, pa.array([len(more) for _, more in found], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.mapInArrow(_in_slices(fn), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
