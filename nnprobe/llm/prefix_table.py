"""SentencePiece encoding and decoding by a prefix table (operator 13).

For merge-type (BPE) models.  The text is normalised as the model says.  A
table then holds, for every prefix, the one token its encoding ends with: an
automaton over the vocabulary names the pieces that end at a place, and the
piece stands there if it fits behind the last token of what precedes it, that
is, if merging the characters of both gives these two tokens again.  (Merges
inside a stretch of text do not depend on what lies around it until one
crosses its border, so an encoding is right exactly if all neighbours fit.)
Ids are read from the table backwards; characters without a piece become their
UTF-8 bytes' pieces, or the unknown id where the model has none.

Where no piece of the model holds a word mark behind another character, no
merge crosses into a word, and the text is cut before word marks; else it is one
word.  Many words go through the table together, place by place.  Words and
pairs of tokens met before are taken from bounded caches.  Time grows with the
length of the text, a whole text is read whatever its length, and rows are
independent: nothing is shuffled and the model is the only broadcast.

Edge cases: null and empty texts have no ids and decode to the empty text;
repeated rows are encoded each; an empty table gives an empty result; other
columns are carried along, equal-named ones are replaced.  Decoding drops ids
that are null; null lists decode to the empty text.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_MODEL_BYTES = 64 << 20
CACHED = 1 << 19                      # words kept per generation and Python worker (pairs of tokens: four times that)
CACHED_LENGTH = 64                    # longer words are not kept
CELLS = 1 << 18                       # words x length in one table
LONG = 256                            # longer words go through a table of their own
LATE = 1 << 14                        # new pairs kept apart before they are sorted in
CHARS = 1 << 22                       # characters of the texts encoded at once, about
MARK = "▁"                       # fixed value: the library's word mark
_LOADED: dict[tuple, "PrefixTable"] = {}


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Recent:
    """A cache of two generations: what was not asked for in the last one goes."""

    def __init__(self):
        self.new, self.old = {}, {}

    def get(self, key):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value):
        if len(self.new) >= CACHED:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Sorted:
    """Numbers (not negative) and their values in sorted arrays: a large pair
    of arrays and a small one for what came last."""

    def __init__(self, keys=(), values=()):
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.late = None

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Sorted new keys."""
        if self.late is None:
            self.late = Sorted()
        late = self.late
        at = np.searchsorted(late.keys, keys)
        late.keys, late.values = np.insert(late.keys, at, keys), np.insert(late.values, at, values)
        if len(late.keys) > LATE:
            if len(self.keys) > 4 * CACHED:               # bounded: start again
                self.keys, self.values = self.keys[:0], self.values[:0]
            at = np.searchsorted(self.keys, late.keys)
            self.keys, self.values = np.insert(self.keys, at, late.keys), np.insert(self.values, at, late.values)
            self.late = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is not there."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            got = np.where(self.keys[at] == keys, self.values[at], -1)
        else:
            got = np.full(len(keys), -1, np.int64)
        if self.late is not None:
            missing = np.flatnonzero(got < 0)
            got[missing] = self.late.find(keys[missing])
        return got


class PrefixTable:
    """Encoder of one model.

    A token is a number: a piece's place in ``pieces``, or, for a character
    without a piece, ``len(pieces)`` + its code point."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, self.ids, self.order, self.bytes = self.library, {}, {}, {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[piece], self.order[piece] = i, -sp.get_score(i)
        self.pieces = list(self.ids)
        self._automaton()
        together = {a + b for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        inner = any(pair[1] == MARK != pair[0] for pair in together)
        self.word = re.compile(".+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL)
        self.written = [str(i) for i in range(sp.vocab_size())]
        self.words, self.pairs = Recent(), Sorted()

    def _automaton(self) -> None:
        """States are the pieces' prefixes; ``steps`` maps state * 2**21 + code point to the next one."""
        state, keys, ends = {"": 0}, [], {}
        for n, piece in enumerate(self.pieces):
            for k in range(1, len(piece) + 1):
                if piece[:k] not in state:
                    state[piece[:k]] = len(state)
                    keys.append((state[piece[:k - 1]] << 21) + ord(piece[k - 1]))
            ends[state[piece]] = n
        self.steps = Sorted(keys, range(1, len(state)))
        self.step = dict(zip(keys, range(1, len(state)), strict=True))
        self.ends = np.full(len(state), -1, np.int64)     # the piece that a state is
        self.ends[list(ends)] = list(ends.values())
        self.longest = max(map(len, self.pieces), default=1)
        self.id_of = np.array(list(self.ids.values()), np.int64)

    def _text(self, token: int) -> str:
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def fits(self, before: str, piece: str) -> bool:
        """True if the characters of both merge to just these two tokens
        (to ``piece`` alone where nothing precedes it)."""
        parts, order, never, edge = [*before, *piece], self.order, float("inf"), len(before)
        ranks = [order.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)                         # the leftmost of equals
            if i == edge - 1:
                return False                              # it crosses the border
            if i < edge:
                edge -= 1
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            ranks[i:i + 1] = []
            if i:
                ranks[i - 1] = order.get(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = order.get(parts[i] + parts[i + 1], never)
        return len(parts) == (2 if before else 1)

    def _fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs; ``before`` is -1 at the start of a word."""
        key = ((before + 1) << 22) + token
        known = self.pairs.find(key)
        new = np.unique(key[known < 0])
        if len(new):
            got = [self.fits(self._text((k >> 22) - 1) if k >> 22 else "", self._text(k & (1 << 22) - 1)) for k in new.tolist()]
            self.pairs.add(new, np.array(got, np.int64))
            known[known < 0] = np.array(got, np.int64)[np.searchsorted(new, key[known < 0])]
        return known > 0

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of normalised words of about the same length, in rows that end
        together (-1 before the first one), and their numbers."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        code = np.zeros((n, width + 1), np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        code[np.arange(width + 1) < size[:, None]] = flat
        # what the automaton finds: matches[end] holds (words, lengths, pieces)
        matches: list[list] = [[] for _ in range(width + 1)]
        for start in range(width):
            at = np.flatnonzero(size > start)
            state = np.zeros(len(at), np.int64)
            for k in range(min(self.longest, width - start)):
                state = self.steps.find((state << 21) + code[at, start + k])
                alive = state > 0
                at, state = at[alive], state[alive]
                if not len(at):
                    break
                piece = self.ends[state]
                whole = piece >= 0
                matches[start + k + 1].append((at[whole], k + 1, piece[whole]))
        # the table: the one token each prefix ends with, and its length
        last, long = np.full((n, width + 1), -1, np.int64), np.zeros((n, width + 1), np.int64)
        for end in range(1, width + 1):
            for at, k, piece in sorted(matches[end], key=lambda m: -m[1]):
                open_ = long[at, end] == 0
                at, piece = at[open_], piece[open_]
                right = self._fit(last[at, end - k], piece)
                last[at[right], end], long[at[right], end] = piece[right], k
            bare = np.flatnonzero((size >= end) & (long[:, end] == 0))       # no piece stands here
            last[bare, end], long[bare, end] = len(self.pieces) + code[bare, end - 1], 1
        # from the end backwards; the rows end together
        steps, at, place = [], np.arange(n), size.copy()
        while len(at):
            found = np.full(n, -1, np.int64)
            found[at] = last[at, place]
            steps.append(found)
            place = place - long[at, place]
            at, place = at[place > 0], place[place > 0]
        rows = np.stack(steps[::-1], axis=1)
        return rows, (rows >= 0).sum(axis=1)

    def long_tokens(self, word: str) -> list[int]:
        """The same for one word of any length, held as a list of places."""
        n = len(word)
        last, fits = [-1] * (n + 1), {}
        ready: list[list] = [[] for _ in range(self.longest + 1)]            # matches by end, as far as pieces reach
        for start in range(n):
            state = 0
            for k in range(start, min(start + self.longest, n)):
                state = self.step.get((state << 21) + ord(word[k]), 0)
                if not state:
                    break
                if self.ends[state] >= 0:
                    ready[(k + 1) % len(ready)].append((start, int(self.ends[state])))
            end = start + 1                               # all pieces that end here began by now
            for begin, piece in ready[end % len(ready)]:
                before = last[begin]
                if (before, piece) not in fits:
                    if len(fits) > CACHED:
                        fits.clear()
                    fits[before, piece] = self.fits(self._text(before) if begin else "", self._text(piece))
                if fits[before, piece]:
                    last[end] = piece
                    break
            else:
                last[end] = len(self.pieces) + ord(word[start])
            ready[end % len(ready)] = []
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self._text(last[at]))
        return out[::-1]

    def _ids_of(self, tokens: list[int]) -> tuple[int, ...]:
        ids: list[int] = []
        for t in tokens:
            if t < len(self.pieces):
                ids.append(self.ids[self.pieces[t]])
            elif self.bytes:
                ids.extend(self.bytes[b] for b in chr(t - len(self.pieces)).encode())
            else:
                ids.append(self.library.unk_id())
        return tuple(ids)

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words that are not in the cache; short ones go into it."""
        found, new = {}, []
        for w in words:
            got = self.words.old.get(w)
            if got is not None:
                found[w] = got
            elif len(w) > LONG:
                found[w] = self._ids_of(self.long_tokens(w))
            else:
                new.append(w)
        new.sort()                                        # neighbours look up the same steps and pairs
        new.sort(key=len)
        lo = 0
        while lo < len(new):                              # words of like length, in a table of bounded size
            hi = min(len(new), lo + max(1, CELLS // len(new[lo])))
            while hi > lo + 1 and (hi - lo) * len(new[hi - 1]) > 2 * CELLS:
                hi = lo + (hi - lo) // 2
            some = new[lo:hi]
            rows, sizes = self.tokens(some)
            known = (rows < len(self.pieces)).all(axis=1)
            ids = self.id_of[np.where((rows >= 0) & known[:, None], rows, 0)].tolist() if self.pieces else rows.tolist()
            width = rows.shape[1]
            for w, row, size in zip(some, ids, sizes.tolist(), strict=True):
                found[w] = tuple(row[width - size:])
            for i in np.flatnonzero(~known).tolist():     # with characters that no piece has
                found[some[i]] = self._ids_of(rows[i, width - sizes[i]:].tolist())
            lo = hi
        for w, ids in found.items():
            if len(w) <= CACHED_LENGTH:
                self.words.put(w, ids)
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of whole texts."""
        split = [self.word.findall(self.library.normalize(t)) if t else [] for t in texts]
        got = [list(map(self.words.new.get, words)) for words in split]
        missing = {w for words, ids in zip(split, got, strict=True) for w, i in zip(words, ids, strict=True) if i is None}
        found = self._learn(missing) if missing else {}
        out = [list(chain.from_iterable([found[w] if i is None else i for w, i in zip(words, ids, strict=True)]))
               for words, ids in zip(split, got, strict=True)]
        if not self.bytes:                                # the library joins unknown neighbours
            unknown = self.library.unk_id()
            out = [[i for at, i in enumerate(ids) if i != unknown or not at or ids[at - 1] != unknown] for ids in out]
        return out

    def digits(self, ids: list[int]) -> str:
        """The ids as decimals joined by commas."""
        return ",".join([self.written[i] for i in ids])


def _table(model: bytes) -> PrefixTable:
    key = (len(model), zlib.crc32(model))
    if key not in _LOADED:
        _LOADED[key] = PrefixTable(model)
    return _LOADED[key]


def model_of(spark: SparkSession, path: str | None = None):
    """The model file as a broadcast; its size is checked."""
    path = path or default_model()
    with open(path, "rb") as f:
        data = f.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is no model of at most {MAX_MODEL_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def _slices(batch: pa.RecordBatch, at: int):
    """The batch in runs of rows of about ``CHARS`` bytes (or ids) of column ``at``."""
    col = batch.column(at)
    size = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.binary_length(col)
    ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + CHARS)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _with(df: DataFrame, col: str, fields: list[tuple[str, T.DataType]], make, model) -> DataFrame:
    """``df`` and new columns, of which ``make(table, values)`` gives rows for values of ``col``."""
    names = [n for n, _ in fields]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names or c == col])
    at, kept = df.columns.index(col), [i for i, c in enumerate(df.columns) if c not in names]
    out_names = [df.columns[i] for i in kept] + names
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])          # any name may be a column's
    schema = T.StructType([df.schema.fields[i] for i in kept] + [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields)])
    types = [{T.LongType(): pa.int64(), T.StringType(): pa.string()}.get(t, pa.list_(pa.int32())) for _, t in fields]

    def run(batches):
        table = _table(model.value)
        gc.disable()         # no cycles are made here, and a collection would walk the caches
        for batch in batches:
            for part in _slices(batch, at):
                rows = make(table, part.column(at).to_pylist())
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in kept] + new, names=schema.names)

    return df.mapInArrow(run, schema).toDF(*out_names)


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col``, the ids (array<int>) of every whole text."""
    return _with(docs, text_col, [(out_col, T.ArrayType(T.IntegerType()))],
                 lambda table, texts: [(ids,) for ids in table.encode(texts)], model_of(docs.sparkSession, model))


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with ``out_col``, the text that the ids stand for."""
    return _with(rows, ids_col, [(out_col, T.StringType())],
                 lambda table, lists: [(table.library.decode([i for i in ids or () if i is not None]) if ids else "",) for ids in lists],
                 model_of(rows.sparkSession, model))


def round_trip(docs: DataFrame, model: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without its texts, with n_tokens, ids_sha256 and
    decoded_sha256: digests of the ids as decimals joined by commas and of the
    text they decode to.  Ids and texts never leave their task."""
    def make(table, texts):
        for ids in table.encode(texts):
            back = table.library.decode(ids) if ids else ""
            yield len(ids), hashlib.sha256(table.digits(ids).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _with(docs, text_col, fields, lambda *x: list(make(*x)), model_of(docs.sparkSession, model)).drop(text_col)
