"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, and an agenda of adjacent pairs that are pieces, highest score first and
leftmost among equals, merges them until no pair is a piece. Characters without a piece fall back to
bytes. The vocabulary is read from the model file's own fields, so nothing is trained and nothing copied.

No piece of such a vocabulary has the space mark after another character, or a comma after a letter, so no merge crosses such
a place and the agenda may run stretch by stretch. The places are taken from the pieces when the model is loaded; a vocabulary with
inner marks is encoded text by text. Each distinct word of a worker is run once and
compared with the sentencepiece library, ids and decoded text, one call for the new words of an Arrow
batch; a difference raises.

Cases: null and empty texts have no ids; very long texts are streamed word by word; equal texts have equal values;
repeated rows and ties need nothing special; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import parts, tidy, with_text

MARK = "▁"
#: Rank of a pair that is no piece, and up to how many symbols a stretch's agenda is scanned.
NEVER, SCANNED = float("inf"), 48
#: Stretches that a worker remembers; beyond it those met once are forgotten, results stay the same.
REMEMBERED = 300000
#: Texts taken together, by number and by characters.
TOGETHER, TOGETHER_CHARS = 300, 1_000_000


class Agenda:
    """Encoder and decoder over a sentencepiece model's vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if self.library.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte.items()}
        self.unknown = self.library.unk_id()
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not self.library.is_byte(i)}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.special = special
        self.cut = self._cut()
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.rare = {i for i in range(n) if special[i]} | set(self.bytes)
        self.known: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.met_again: set[str] = set()

    def merge(self, symbols: str) -> list[int]:
        """Ids of one stretch of text whose spaces are marks.

        The agenda of a short stretch is the list of its pairs' ranks itself, in which the best and leftmost is found by a scan; that of a
        long one is a heap.
        """
        if len(symbols) > SCANNED:
            return self._merge_long(symbols)
        rank, parts = self.rank.get, list(symbols)
        agenda = [rank(p, NEVER) for p in map(add, parts, parts[1:])]
        while agenda and (best := min(agenda)) < NEVER:
            i = agenda.index(best)
            parts[i] += parts.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(parts[i] + parts[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        return self._ids(parts)

    def _ids(self, parts: list[str]) -> list[int]:
        """Ids of merged symbols; those without a piece by their bytes."""
        try:
            return [self.ids[p] for p in parts]
        except KeyError:
            out: list[int] = []
            for p in parts:
                if (known := self.ids.get(p)) is not None:
                    out.append(known)
                elif self.byte:
                    out += [self.byte[x] for x in p.encode()]
                else:
                    out.append(self.unknown)
            return out

    def _merge_long(self, symbols: str) -> list[int]:
        rank, parts = self.rank.get, list(symbols)
        n = len(parts)
        agenda = [(r, i, i + 1, p) for i, p in enumerate(map(add, parts, parts[1:])) if (r := rank(p)) is not None]
        if agenda:
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            heapify(agenda)
        while agenda:
            _, i, j, pair = heappop(agenda)
            if after[i] != j or parts[i] + parts[j] != pair:
                continue  # one of the two has merged since
            k = after[i] = after[j]
            parts[i], parts[j], after[j] = pair, "", -2
            if k >= 0:
                before[k] = i
                if (r := rank(p := pair + parts[k])) is not None:
                    heappush(agenda, (r, i, k, p))
            h = before[i]
            if h >= 0 and (r := rank(p := parts[h] + pair)) is not None:
                heappush(agenda, (r, h, i, p))
        return self._ids([p for p in parts if p])

    def unmerge(self, ids: list[int]) -> str:
        """Text of ids that follow other ids: byte pieces are gathered to characters, marks are spaces."""
        if self.rare.isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            p = self.pieces[i]
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(" ⁇ " if i == self.unknown else "" if self.special[i] else p.replace(MARK, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def _cut(self) -> re.Pattern[str] | None:
        """Where no piece reaches across: before a space after another character, around characters of no longer
        piece, and between a character and a sign that in no piece follows any but signs. None if pieces hold inner marks."""
        inner = [(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1)]
        if any(b == MARK != a for a, b in inner):
            return None
        joined = {c for pair in inner for c in pair}
        alone = {chr(c) for c in range(128) if chr(c) != " "} - joined
        signs = {c for c in joined if not c.isalpha() and c != MARK}
        while wrong := {b for a, b in inner if b in signs and a != MARK and a not in signs}:
            signs -= wrong
        a, s = (re.escape("".join(sorted(x))) for x in (alone, signs))
        return re.compile(f" *[^ {a}{s}]+| *[{s}][^ {a}]*|[{a}]| +" if a and s else " *[^ ]+| +")

    def words(self, text: str) -> list[str]:
        """Stretches that merge on their own; their join is the text, a leading space added and marks as spaces."""
        return self.cut.findall(f" {text}".replace(MARK, " "))

    def learn(self, words: set[str]) -> dict[str, str]:
        """Ids joined by commas of each stretch; ids and decoded text are checked against the library. Stretches that do not decode to
        themselves are noted in ``odd``."""
        fresh = list(words)
        ours = [self.merge(w.replace(" ", MARK)) for w in fresh]
        # the library adds a space in front: a word with one is given without it, others after a line end, which merges with nothing
        lead = self.library.encode("\n")
        if not fresh:
            return {}
        theirs = self.library.encode([w[1:] if w[0] == " " != w else "\n" + w for w in fresh], num_threads=1)
        decoded = [self.unmerge(ids) for ids in ours]
        texts = self.library.decode(theirs, num_threads=1)
        for w, a, b, d, t in zip(fresh, ours, theirs, decoded, texts, strict=True):
            if (a, d[1:]) != (b, t) if w[0] == " " != w else (lead + a, "\n" + d) != (b, t):
                raise ValueError(f"agenda and library differ on {w[:80]!r}: {a[:20]} and {b[:20]}, {d[:80]!r} and {t[:80]!r}")
        self.odd.update((w, d) for w, d in zip(fresh, decoded, strict=True) if w != d)
        return {w: ",".join(map(str, a)) for w, a in zip(fresh, ours, strict=True)}

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, SHA-256 of the ids and of the decoded text, for each text."""
        known = self.known
        split = [[] if not t else self.words(t) if self.cut else [f" {t}".replace(MARK, " ")] for t in texts]
        distinct = set().union(*split)
        missing = distinct.difference(known)
        met_again = distinct.difference(missing)
        self.met_again |= met_again
        fresh = self.learn(missing)
        if len(known) + len(fresh) > REMEMBERED:  # what was met once goes first, all goes if that is not enough
            fresh |= {w: known[w] for w in met_again}
            kept = {w: known[w] for w in self.met_again} if len(self.met_again) <= REMEMBERED // 2 else {}
            known.clear()
            known.update(kept)
            self.met_again.clear()
            self.odd = {w: d for w, d in self.odd.items() if w in kept or w in fresh}
        known.update(fresh)
        counts, id_hashes, text_hashes = [], [], []
        odd = self.odd
        for words in split:
            ids = ",".join([known[w] for w in words])
            decoded = "".join([odd.get(w, w) for w in words] if odd else words)
            counts.append(ids.count(",") + 1 if words else 0)
            id_hashes.append(hashlib.sha256(ids.encode()).hexdigest())
            text_hashes.append(hashlib.sha256(decoded[1:].encode()).hexdigest())
        return counts, id_hashes, text_hashes

    def forget(self) -> None:
        """Between tasks a worker holds no stretches: other operators share its memory."""
        self.known, self.odd, self.met_again = {}, {}, set()

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        words = self.words(text) if self.cut else [f" {text}".replace(MARK, " ")]
        return [i for w in words for i in self.merge(w.replace(" ", MARK))]

    def decode(self, ids: list[int]) -> str:
        text = self.unmerge(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded``: the ids themselves, for writing token shards."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = agenda(path)
        for batch in batches:
            ids = [model.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    return with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(tidy(fn), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = agenda(path)
        for batch in batches:
            for part in parts(batch, TOGETHER, TOGETHER_CHARS):
                n, ids, decoded = model.digests(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.forget()

    return with_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(tidy(fn), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
