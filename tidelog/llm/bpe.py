"""Byte-level BPE as a lazily determinised finite-state transducer.

Why a transducer can do it: where every token is its own encoding, a sequence of tokens is the encoding of its bytes
exactly if each pair of neighbours is the encoding of the pair's bytes. So the encoding of a prefix is the encoding of
a shorter prefix and one more token, and the tokens that may still begin in the part already read are the prefixes of
tokens that end where reading stopped. A state holds, for each such beginning, the place in the trie of tokens and the
tokens that aren't certain yet; what all beginnings have in common is emitted. No beginning lies further back than the
longest token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from tidelog.llm.common import map_arrow, with_id

#: Entries after which a worker forgets a part of a table: memory stays bounded whatever the corpus holds.
MAX_STATES, MAX_PAIRS, MAX_WORDS = 400_000, 1_000_000, 400_000
#: Tokens that may still complete a beginning, so few that what came before is told by which of them it rules out.
FEW = 64
#: Characters after which a text is cut at the next place where no match of the pattern can span.
CHUNK = 1 << 20
SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ranks from the text of a rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


class State:
    __slots__ = ("before", "begun", "tail", "to")

    def __init__(self, before, begun):
        #: What the first beginning follows: the last token emitted, or the tokens that can't follow it, which is all there
        #: is to know about it; (trie place, uncertain tokens) of each beginning, the last at the trie's root.
        self.before, self.begun = before, begun
        self.tail = begun[-1][1]
        self.to: dict = {}


class Transducer:
    """Bytes of one pre-token to ids; decoding is by table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int | None] = [None]
        for token, rank in ranks.items():
            place = 0
            for b in token:
                step = self.trie[place].get(b)
                if step is None:
                    step = self.trie[place][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                place = step
            self.token_at[place] = rank
        #: The tokens that lie below a place of the trie, if they are few.
        self.below: list[tuple[int, ...] | None] = [()] * len(self.trie)
        for place in range(len(self.trie) - 1, -1, -1):
            found: tuple[int, ...] | None = ()
            for child in self.trie[place].values():
                rest, own = self.below[child], self.token_at[child]
                found = None if found is None or rest is None else (*found, *rest, *(() if own is None else (own,)))
            self.below[place] = found if found is not None and len(found) <= FEW else None
        #: The two tokens whose merge made each token; a byte stands for itself.
        self.halves = {r: (r, r) if len(t) == 1 else self.split(t) for t, r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.start = State((), ((0, ()),))
        self.states: dict = {((), self.start.begun): self.start}

    def forget(self) -> None:
        """Drops the states that lead to one other at most: the ends of rare words, which are most of the states."""
        kept = {k: s for k, s in self.states.items() if len(s.to) > 1}
        if len(kept) * 2 > MAX_STATES:
            kept = {}
        rest = set(map(id, kept.values()))
        for state in self.states.values():
            # Dropped states are emptied: they point at each other and would wait for the cycle collector.
            state.to = {b: x for b, x in state.to.items() if id(x[0]) in rest} if id(state) in rest else {}
        self.states = kept
        self.states[(), self.start.begun] = self.start

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Encoding by the definition: the neighbouring pair of lowest rank merges first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: bytes) -> tuple[int, int]:
        for i in range(1, len(token)):
            a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
            if a is not None and b is not None and self.merged(token, below=self.ranks[token]) == [a, b]:
                return a, b
        raise ValueError("a token of the ranks isn't the merge of two others")

    def fit(self, a: int, b: int) -> bool:
        """Whether b may follow a.

        The merges of both are undone from the last to the first; if what then meets at the border makes a token of
        lower rank than the merge just undone, that token would have been made first and the border would be gone.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.border(a, b)
        return known

    def border(self, a: int, b: int) -> bool:
        ranks, text, halves, until = self.ranks, self.bytes_of, self.halves, 1 << 60
        while True:
            if ranks.get(text[a] + text[b], until) < until:
                return False
            left, right = halves[a][1], halves[b][0]
            if left == a and right == b:
                return True
            # At equal ranks the left one merges first, so a merge on the right is undone first.
            if right != b and (b >= a or left == a):
                until, b = b + 1, right
            else:
                until, a = a, left

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The transition that isn't in the table yet."""
        begun, sure, trie, token_at, pairs = [], None, self.trie, self.token_at, self.pairs
        for place, open_ in state.begun:
            place = trie[place].get(byte)
            if place is None:
                continue
            if sure is None and (token := token_at[place]) is not None:
                if open_ or type(state.before) is int:
                    last = open_[-1] if open_ else state.before
                    fits = pairs.get(last << 32 | token)
                    fits = self.fit(last, token) if fits is None else fits
                else:
                    fits = token not in state.before
                if fits:
                    sure = (*open_, token)
            if trie[place]:
                begun.append((place, open_))
        if sure is None:
            raise ValueError("the ranks aren't those of a byte-level BPE")
        n = len(sure)
        for _, open_ in begun:
            if not open_ or not n:
                n = 0
                break
            while open_[:n] != sure[:n]:
                n -= 1
        begun.append((0, sure))
        before, out = state.before, sure[:n]
        if n:
            before, begun = sure[n - 1], [(p, o[n:]) for p, o in begun]
        if before != ():
            first = begun[0]
            if first[1]:
                before = ()
            elif (below := self.below[first[0]]) is not None:
                before = tuple([t for t in below if not self.fit(before, t)] if type(before) is int else [t for t in below if t in before])
        key = before, tuple(begun)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(*key)
        state.to[byte] = to, out
        return to, out

    def encode(self, data: bytes) -> tuple[int, ...]:
        if len(self.states) > MAX_STATES:
            self.forget()
        state, ids = self.start, []
        for byte in data:
            state, out = state.to.get(byte) or self.step(state, byte)
            if out:
                ids += out
        return (*ids, *state.tail)


class Utf8Stream:
    """Incremental UTF-8: bytes in pieces of any length, text out; an unfinished character waits for its other bytes."""

    #: Lead bytes of characters of 2, 3 and 4 bytes begin at these.
    LEADS = ((0xF0, 4), (0xE0, 3), (0xC0, 2))

    def __init__(self):
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        end = len(data)
        for back in range(1, min(3, end) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                need = next(n for lead, n in self.LEADS if byte >= lead)
                end -= back if need > back else 0
                break
        self.waiting = data[end:]
        return data[:end].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = load_ranks(rank_file)
        self.fst, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.token_bytes = [self.fst.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.decimal = [str(i) for i in range(len(self.token_bytes))]
        self.before: dict[str, tuple[int, ...]] = {}
        codec = self

        class Words(dict):
            def __missing__(self, word):
                if len(self) >= MAX_WORDS:
                    codec.before = self.copy()  # words that come again before as many others have come return from there
                    self.clear()
                ids = codec.before.get(word)
                if ids is None:
                    ids = codec.fst.encode(word.encode())
                if len(word) <= 64:
                    self[word] = ids
                return ids

        self.words = Words()

    def chunks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CHUNK and (cut := SAFE_CUT.search(text, at + CHUNK)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids, a list for each part of the text."""
        for part in self.chunks(text):
            yield list(chain.from_iterable(map(self.words.__getitem__, self.find(part))))

    def decode(self, parts: Iterator[list[int]]) -> Iterator[str]:
        """Text of the ids, as far as it is complete after each part."""
        stream = Utf8Stream()
        for ids in parts:
            yield stream.feed(b"".join(map(self.token_bytes.__getitem__, ids)))
        yield stream.close()


_codecs: dict[tuple, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec per worker process: its tables fill as it goes and serve the later tasks."""
    key = hashlib.sha256(rank_file).digest(), pattern
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


@contextmanager
def no_collector():
    """Stops the cycle collector, which would walk the growing tables again and again; they hold no cycles that aren't broken by hand."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def with_codec(run: Callable, ranks: Broadcast, pattern: str) -> Callable:
    """A function of Arrow batches from run(codec, batch), without the collector while it lasts."""

    def batches_of(batches):
        with no_collector():
            c = codec(ranks.value, pattern)
            for b in batches:
                yield run(c, b)

    return batches_of


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the tokens of each text. A null text is empty and has no tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(c, b):
        ids = [[i for part in c.encode(t or "") for i in part] for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return map_arrow(docs.select(id_col, text_col), with_codec(run, shared, pattern), with_id(docs, id_col, "ids array<int>")).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of each array of ids; bytes that are no UTF-8 become U+FFFD. A null array gives an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(rank_file)

    def run(c, b):
        text = ["".join(c.decode(iter([i or []]))) for i in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["id", "text"])

    return map_arrow(tokens.select(id_col, ids_col), with_codec(run, shared, pattern), with_id(tokens, id_col, "text string")).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents, without the ids leaving the worker.

    A null or empty text has no tokens and the digest of nothing. Equal rows give equal rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(c, b):
        n, sent, back = [], [], []
        for text in b.column(1).to_pylist():
            count, ids_sha, text_sha, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
            for ids in c.encode(text or ""):
                if ids:
                    ids_sha.update(((" " if count else "") + " ".join(map(c.decimal.__getitem__, ids))).encode())
                    count += len(ids)
                    text_sha.update(stream.feed(b"".join(map(c.token_bytes.__getitem__, ids))).encode())
            text_sha.update(stream.close().encode())
            n.append(count)
            sent.append(ids_sha.hexdigest())
            back.append(text_sha.hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sent), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), with_codec(run, shared, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
