"""Encoding and decoding of a whole corpus with a public byte-level BPE, as a bounded-lookahead streaming transducer.

The merge list's *sufficient lookahead* is computed from the list itself (:func:`sufficient_lookahead`): a token that ends that
many bytes before the end of what has been read is the same whatever follows. :class:`Transducer` reads one word in pieces,
merges a window and emits exactly the tokens that the lookahead makes stable; what it keeps is bounded by the window.
:class:`Encoder` cuts a text into words with a few characters of lookahead and hands every one of them, short or long, to a
transducer; words seen before come from a bounded memo of its output. ``Decoder`` turns ids into text byte by byte and holds
back only an unfinished character. No tokenizer library takes part; the tests compare with two of them.

Defined results: NULL and '' have the empty list of ids; special token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import json
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
# Fixed value: the splitting pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The classes whose runs the pattern keeps in one word.
_CLASSES = (regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"[^\s\p{L}\p{N}]+"))
_SPACE = regex.compile(r"\s+")
_SPLIT = regex.compile(PATTERN)
#: Characters of an unfinished word that are held back as text before they go to its transducer; entries of the memo.
OPEN, MEMO = 2048, 200_000
PIECE = 1 << 16


def _byte_of_character() -> dict[str, int]:
    """The printable alphabet in which byte-level vocabularies are written: bytes without a visible form come after 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """(ids of the tokens, merge list in order) of a vocabulary file: JSON with its merges, or ranks from which they follow."""
    if path.endswith(".json"):
        byte = _byte_of_character()
        raw = lambda s: bytes(map(byte.__getitem__, s))
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        merges = [(raw(a), raw(b)) for a, b in pairs]
        used = {a + b for a, b in merges} | {bytes([b]) for b in range(256)}
        return {t: i for t, i in ((raw(s), i) for s, i in model["vocab"].items() if all(c in byte for c in s)) if t in used}, merges
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    merges, rules = [], {}
    for token in sorted(ids, key=ids.__getitem__):
        if len(token) > 1:
            left, right = _merge([token[i : i + 1] for i in range(len(token))], rules)
            merges.append((left, right))
            rules[left, right] = (len(merges), token)
    return ids, merges


def _merge(parts: list, rules: dict) -> list:
    """Applies pair rules (pair -> (rank, joined)) to a sequence of symbols, lowest rank first and leftmost among equals."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rule[0], i, parts[i], parts[i + 1], rule[1]) for i in range(n - 1) if (rule := rules.get((parts[i], parts[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j], k, h = joined, None, after[j], before[i]
        after[i] = k
        if k < n:
            before[k] = i
            if rule := rules.get((joined, parts[k])):
                heapq.heappush(heap, (rule[0], i, joined, parts[k], rule[1]))
        if h >= 0 and (rule := rules.get((parts[h], joined))):
            heapq.heappush(heap, (rule[0], h, parts[h], joined, rule[1]))
    return [p for p in parts if p is not None]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after the end of a token that decide whether it stays, whatever comes later.

    A symbol ``s`` at the right edge of a token is lost only to an earlier rule (s, y) that applies across the edge, ``y`` is
    there only if it isn't lost itself to a still earlier rule across its own edge, and so on: ranks fall strictly along such a
    chain. ``across[s]`` is the reach of the rules that begin with ``s`` so far, ``edge[t]`` that of all symbols at the right
    edge of ``t``, each up to the rank at which ``t``'s own merges take it in. One pass over the list in order of rank.
    """
    across: dict[bytes, int] = defaultdict(int)
    edge: dict[bytes, int] = defaultdict(int)
    for u, v in merges:
        lost = max(edge[v], across[v])
        edge[u + v] = max(edge[u + v], lost, max(edge[u], across[u]) - len(v))
        across[u] = max(across[u], len(v) + lost)
    return max([0, *edge.values(), *across.values()])


class Vocabulary:
    def __init__(self, path: str):
        ids, merges = load(path)
        self.ids, self.merges = ids, merges
        self.longest = max(map(len, ids))
        self.bytes_of = {v: k for k, v in ids.items()}
        self.rules = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(merges)
        self.memo: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        return _merge([self.byte_ids[b] for b in data], self.rules)

    def word(self, text: str) -> list[int]:
        """Ids of one whole word of the splitting pattern."""
        t = Transducer(self)
        ids = t.feed(text.encode("utf-8", "surrogatepass")) + t.finish()
        if len(text) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = ids
        return ids


class Transducer:
    """Ids of one word of any length, fed in pieces: memory is one window of the lookahead and the longest token."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.window, self.open = vocab, 2 * vocab.lookahead + 2 * vocab.longest, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.window):
            self.open += data[i : i + self.window]
            if len(self.open) >= self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """The tokens that end at least the lookahead before the end of what is known; the rest stays open."""
        out, end, last = [], 0, len(self.open) - self.vocab.lookahead
        for i in self.vocab.merged(self.open):
            size = len(self.vocab.bytes_of[i])
            if end + size > last:
                break
            out.append(i)
            end += size
        self.open = self.open[end:]
        return out

    def finish(self) -> list[int]:
        return self.vocab.merged(self.open)


class Encoder:
    """Streaming encoder; memory is bounded by a piece, a transducer's window and the open end of the text."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held, self.word, self.kind = vocab, "", None, None

    def feed(self, text: str) -> list[int]:
        self.held += text
        return self._run(False)

    def finish(self, text: str = "") -> list[int]:
        self.held += text
        return self._run(True)

    def _run(self, end: bool) -> list[int]:
        out: list[int] = []
        if self.word is not None:
            m = self.kind.match(self.held)
            size = m.end() if m else 0
            if self.kind is _SPACE and not (end and size == len(self.held)):
                size = max(size - 1, 0)  # the last space of a run belongs to what follows, if anything does
                if size + 1 >= len(self.held) and not end:
                    out += self.word.feed(self.held[:size].encode())
                    self.held = self.held[size:]
                    return out
            out += self.word.feed(self.held[:size].encode("utf-8", "surrogatepass"))
            self.held = self.held[size:]
            if not self.held and not end:
                return out
            out += self.word.finish()
            self.word = None
        stable, memo, new = 0, self.vocab.memo.get, self.vocab.word
        if end:
            for w in _SPLIT.findall(self.held):
                out += memo(w) or new(w)
            self.held = ""
            return out
        for m in _SPLIT.finditer(self.held):
            if m.end() > len(self.held) - 3:
                break
            w = m.group()
            out += memo(w) or new(w)
            stable = m.end()
        self.held = self.held[stable:]
        if len(self.held) >= OPEN:
            first = self.held[0]
            for kind in _CLASSES:
                m = kind.match(self.held, 1 if first == " " else 0)
                if m and m.end() >= OPEN:
                    # the run may go on; the class alone decides where it ends
                    self.word, self.kind, size = Transducer(self.vocab), kind, m.end()
                    break
            else:
                m = _SPACE.match(self.held)
                if m and m.end() >= OPEN:
                    self.word, self.kind, size = Transducer(self.vocab), _SPACE, m.end() - 1
            if self.word is not None:
                out += self.word.feed(self.held[:size].encode("utf-8", "surrogatepass"))
                self.held = self.held[size:]
        return out


class Decoder:
    """Incremental ids -> text: bytes of each token run through a UTF-8 state machine that holds back open characters."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.vocab.bytes_of[i] for i in ids))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: str | None, vocab: Vocabulary) -> list[int]:
    """Ids of a whole text, streamed in pieces."""
    if not text:
        return []
    e, out, last = Encoder(vocab), [], max(0, (len(text) - 1) // PIECE * PIECE)
    for i in range(0, last, PIECE):
        out += e.feed(text[i : i + PIECE])
    return out + e.finish(text[last:])


def decode(ids: Iterable[int], vocab: Vocabulary) -> str:
    d = Decoder(vocab)
    return d.feed(ids) + d.finish()


def tokenizer_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The vocabulary's file: the one with an explicit merge list where there is one."""
    base = os.path.join(folder or TOKENIZERS, name)
    return f"{base}.json" if os.path.exists(f"{base}.json") else f"{base}.tiktoken"


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """(key, ids): Arrow batches in, list arrays out; no shuffle."""
    path = path or tokenizer_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            rows = [encode(t, vocab) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.fromiter((i for r in rows for i in r), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, ids])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its text; 0 for NULL and ''."""
    path = path or tokenizer_path()

    @F.pandas_udf("long")
    def sizes(texts):
        import pandas as pd

        vocab = vocabulary(path)
        return pd.Series([len(encode(t, vocab)) for t in texts], dtype="int64")

    return df.withColumn(out, sizes(F.col(text)))
