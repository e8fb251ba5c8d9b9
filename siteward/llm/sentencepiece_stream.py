"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model file is of the BPE kind, so the best path is not the one of largest score but the one that its merges give. It
still has the form of a Viterbi pass: each prefix of a text has one encoding, whose last piece is the one that ends there
and is compatible with the last piece of the prefix before it - two pieces are compatible if encoding both together
gives back the two. So each position keeps one backpointer, at most the longest piece away; the paths that survive are
those of the last `longest piece` positions, and as soon as they all go through one boundary, the ids before it are
committed and forgotten. Where no piece can reach over a boundary (before a white-space mark that follows another
character, as the vocabulary shows), all paths meet at once, and the ids of such a span are kept in a bounded cache.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteward.llm.common import table, tokenizer_path

SPACE = "▁"
CACHE_ENTRIES = 100_000
CACHED_CHARS = 64
#: Texts and spans that are encoded together; known pairs of pieces; a bound over piece ids and characters.
TEXTS = 256
SPANS_AT_ONCE = 12_000
FITS = 1_000_000
CODES = 1 << 24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EMPTY = -1
NORMAL, BYTE = 1, 6
NO_PIECE = float("-inf")
SPANS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Table:
    """From whole numbers, 0 or more, to whole numbers, by open addressing in arrays; many keys are looked up at once."""

    def __init__(self, bits: int = 12):
        self.count, self.shift, self.mask = 0, np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, EMPTY, np.int64), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MULTIPLIER) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, EMPTY where there is none."""
        at = self.slots(keys)
        held = self.keys[at]
        same = held == keys
        out = np.where(same, self.values[at], EMPTY)
        rest = np.flatnonzero(~same & (held != EMPTY))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            held = self.keys[at[rest]]
            same = held == keys[rest]
            out[rest[same]] = self.values[at[rest[same]]]
            rest = rest[~same & (held != EMPTY)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys, each once and none of them held yet."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            held = self.keys != EMPTY
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.__init__((2 * len(keys)).bit_length())
        self.count += len(keys)
        at, rest = self.slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] == EMPTY]
            self.keys[at[free]] = keys[free]  # of several for one slot, the last
            won = self.keys[at[rest]] == keys[rest]
            self.values[at[rest[won]]] = values[rest[won]]
            rest = rest[~won]
            at[rest] = (at[rest] + 1) & self.mask


class Model:
    """Pieces, scores and the streaming pass of one .model file of kind BPE with byte fallback and no normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalisation is needed")
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.of_byte = {k: b for b, k in self.bytes.items()}
        self.texts, self.last_byte = [p.replace(SPACE, " ") for p in self.pieces], max(self.of_byte)
        self.longest = max(map(len, self.ids))
        self.spans_part = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.fits: dict[tuple[str, str], bool] = {}
        self.starts: dict = {}  # a trie of the pieces that the merges of their own text give
        self.whole = [p for p in self.ids if len(p) == 1 or self.merged(p) == [p]]
        for piece in self.whole:
            node = self.starts
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the cache before this one: what is still in use moves on
        self.children, self.piece_at = self.numbered_trie()
        self.fit_table = Table()

    def merged(self, text: str) -> list[str]:
        """The encoding by definition: of adjacent symbols, merge those that make the best piece, the leftmost of equals."""
        symbols, score = list(text), self.score.get
        if len(symbols) > 4 * self.longest:
            raise ValueError("for two pieces at most")
        gains = [score(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
        while gains and (best := max(gains)) > NO_PIECE:
            k = gains.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = score(symbols[k - 1] + symbols[k], NO_PIECE)
            if k < len(gains):
                gains[k] = score(symbols[k] + symbols[k + 1], NO_PIECE)
        return symbols

    def fit(self, a: str, b: str) -> bool:
        if (a, b) not in self.fits:
            if len(self.fits) > CACHE_ENTRIES:
                self.fits.clear()
            self.fits[a, b] = self.merged(a + b) == [a, b]
        return self.fits[a, b]

    def best_pieces(self, text: str):
        """The pieces of text in order, each as soon as no longer context can change it."""
        marks = len(text) - len(text.lstrip(SPACE))
        if marks < 2:
            yield from self.stream(text)
            return
        # Pieces of white-space marks alone share the lowest score: they form last, from the left, of what words leave.
        rest = self.stream(text[marks - 1 :])
        first = next(rest)
        while marks - (first != SPACE) > 0:
            part = self.merged(SPACE * min(marks - (first != SPACE), 2 * self.longest))
            for piece in part if marks <= 2 * self.longest else part[:1]:
                yield piece
                marks -= len(piece)
        if first != SPACE:
            yield first
        yield from rest

    def stream(self, text: str):
        """The streaming pass: last[k] is the last piece of the encoding that ends at base + k."""
        n, base, last, starts, fits = len(text), 0, [""], self.starts, self.fits
        for j in range(n):
            before = last[j - base]
            node, k = starts, j - base
            last += [None] * (min(n, j + self.longest) - base + 1 - len(last))
            for c in text[j : j + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                k += 1
                piece = node.get("")
                if piece is not None and last[k] is None and (not before or (fits[before, piece] if (before, piece) in fits else self.fit(before, piece))):
                    last[k] = piece
            if last[j - base + 1] is None:
                last[j - base + 1] = text[j]  # a character that is no piece
            if j - base > 8 * self.longest and (to := self.meeting(last, base, j + 1)) > base:
                yield from self.path(last, to - base)
                last, base = last[to - base :], to
                last[0] = last[0] if base else ""
        yield from self.path(last, n - base)

    def meeting(self, last: list[str], base: int, i: int) -> int:
        """The boundary that the paths of all positions a later piece can build on go through; base if there is none yet."""
        live = {*range(i - self.longest + 1, i + 1)}
        while len(live) > 1:
            at = max(live)
            if at - len(last[at - base]) <= base:
                return base
            live.remove(at)
            live.add(at - len(last[at - base]))
        return max(live)

    def path(self, last: list[str], k: int) -> list[str]:
        out = []
        while k > 0:
            out.append(last[k])
            k -= len(last[k])
        return out[::-1]

    def ids_of(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def numbered_trie(self) -> tuple[Table, np.ndarray]:
        """The trie with numbered nodes: from a node and a character to the child, and each node's piece id or EMPTY."""
        todo, keys, piece_at = [(self.starts, 0)], [], [EMPTY]
        for node, number in todo:
            for c, child in node.items():
                if c:
                    keys.append(number * CODES + ord(c))
                    todo.append((child, len(piece_at)))
                    piece_at.append(self.ids[child[""]] if "" in child else EMPTY)
        children = Table()
        children.put(np.array(keys, np.int64), np.arange(1, len(piece_at), dtype=np.int32))
        return children, np.array(piece_at, np.int64)

    def fit_codes(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """fit() of pairs of piece ids; a character that is no piece, with an id past theirs, fits anything."""
        keys = before * CODES + piece
        out = self.fit_table.get(keys)
        rest = np.flatnonzero(out == EMPTY)
        if len(rest):
            unique, back = np.unique(keys[rest], return_inverse=True)
            pairs = (divmod(key, CODES) for key in unique.tolist())
            values = np.array([a >= len(self.pieces) or self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]] for a, b in pairs], np.int32)
            if self.fit_table.count > FITS:
                self.fit_table = Table()
            self.fit_table.put(unique, values)
            out[rest] = values[back]
        return out == 1

    def encode_spans(self, spans: list[str]) -> list[tuple[int, ...]]:
        """The streaming pass over many short spans at once, position by position. All paths meet at a span's end."""
        flat = np.frombuffer("".join(spans).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.array([len(x) for x in spans])
        end = np.cumsum(length)
        start = end - length
        left = np.repeat(end, length) - np.arange(len(flat))  # characters to the span's end
        offset = np.arange(len(flat)) - np.repeat(start, length)
        found, open_, node = [], np.arange(len(flat)), np.zeros(len(flat), np.int64)
        for size in range(1, self.longest + 1):
            if size > 1:
                longer = left[open_] >= size
                open_, node = open_[longer], node[longer]
            if not len(open_):
                break
            node = self.children.get(node * CODES + flat[open_ + (size - 1)]).astype(np.int64)
            alive = node != EMPTY
            open_, node = open_[alive], node[alive]
            ids = self.piece_at[node]
            ok = ids != EMPTY
            found.append((open_[ok], np.full(ok.sum(), size), ids[ok]))
        begin, size, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        to = offset[begin] + size
        order = np.argsort(to.astype(np.int16), kind="stable")
        begin, size, piece, to = begin[order], size[order], piece[order], to[order]
        last, sizes = flat + len(self.pieces), np.ones(len(flat), np.int64)  # characters that are no pieces
        bounds = np.searchsorted(to, np.arange(1, (length.max() if len(length) else 0) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            b, p, n = begin[lo:hi], piece[lo:hi], size[lo:hi]
            inner = offset[b] > 0
            ok = ~inner
            ok[inner] = self.fit_codes(last[b[inner] - 1], p[inner])
            at = b[ok] + n[ok] - 1
            last[at], sizes[at] = p[ok], n[ok]
        ends = np.zeros(len(flat), bool)  # where the pieces of the paths that end with their spans end
        at, first = end - 1, start
        while len(at):
            ends[at] = True
            at = at - sizes[at]
            inside = at >= first
            at, first = at[inside], first[inside]
        pieces, ids = len(self.pieces), last[ends]
        bounds = np.r_[0, np.cumsum(ends)[end - 1]]
        odd = np.flatnonzero(np.add.reduceat(ids >= pieces, bounds[:-1])).tolist()
        ids, bounds = ids.tolist(), bounds.tolist()
        out = [tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
        for k in odd:
            out[k] = tuple(x for i in out[k] for x in ((i,) if i < pieces else [self.bytes[b] for b in chr(i - pieces).encode("utf-8", "replace")]))
        return out

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.cache) > CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        cut = [(SPANS.findall(SPACE + t.replace(" ", SPACE)) if self.spans_part else [SPACE + t.replace(" ", SPACE)]) if t else [] for t in texts]
        missing = {x for spans in cut for x in spans if x not in cache}
        cache.update((x, older[x]) for x in missing if x in older)
        missing = [x for x in missing if x not in older]
        short = [x for x in missing if len(x) <= CACHED_CHARS and x[1:2] != SPACE]
        for k in range(0, len(short), SPANS_AT_ONCE):
            cache.update(zip(short[k : k + SPANS_AT_ONCE], self.encode_spans(short[k : k + SPANS_AT_ONCE])))
        long = {x: tuple(k for piece in self.best_pieces(x) for k in self.ids_of(piece)) for x in missing if x not in cache}
        of = cache.__getitem__ if not long else lambda x: cache[x] if x in cache else long[x]
        return [list(itertools.chain.from_iterable(map(of, spans))) for spans in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each."""
        if min(ids, default=0) > self.last_byte:
            text = "".join(map(self.texts.__getitem__, ids))
            return text[1:] if text[:1] == " " else text
        out, run = [], bytearray()
        pieces, of_byte = self.pieces, self.of_byte
        for k in ids:
            if k in of_byte:
                run.append(of_byte[k])
                continue
            if run:
                out.append(decoded(run))
                run = bytearray()
            out.append(pieces[k])
        if run:
            out.append(decoded(run))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def decoded(run: bytearray) -> str:
    return bytes(run).decode("utf-8", "replace")


@functools.lru_cache(4)
def load(path: str) -> Model:
    return Model(path)


def sentencepiece_encode(text: Column, model: str) -> Column:
    """array<int> of piece ids, as the library gives them for the whole text; null and empty texts have no ids."""
    path = tokenizer_path(model)

    @F.pandas_udf("array<int>")
    def encode(batch: pd.Series) -> pd.Series:
        m = load(path)
        texts, out = batch.tolist(), []
        for k in range(0, len(texts), TEXTS):
            out += m.encode_texts(texts[k : k + TEXTS])
        return pd.Series(out, dtype=object)

    return encode(text)


def sentencepiece_decode(ids: Column, model: str) -> Column:
    """The text of an array of piece ids (null: empty)."""
    path = tokenizer_path(model)

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        m = load(path)
        return pd.Series([m.decode(() if x is None else list(x)) for x in batch], dtype=object)

    return decode(ids)


def sentencepiece_round_trip(text: Column, model: str) -> Column:
    """struct<ids, decoded>: both in one pass, so that a task has one Python worker and one copy of the model."""
    path = tokenizer_path(model)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batch: pd.Series) -> pd.DataFrame:
        m = load(path)
        texts, ids = batch.tolist(), []
        for k in range(0, len(texts), TEXTS):
            ids += m.encode_texts(texts[k : k + TEXTS])
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([m.decode(x) for x in ids], dtype=object)})

    return both(text)


def encoded(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids, n_pieces, decoded_crc32 and decoded_chars of the text that the ids decode to,
    round_trip (it is the text itself; not so where a text has U+2581, which decodes to a space, as in the library). Null
    and empty texts have no ids; equal rows stay apart; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("both", sentencepiece_round_trip(F.col("text"), model)).select("doc_id", "text", "both.*")
    return rows.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_pieces"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents"))
    return rows.withColumn("ids_xxh64", F.xxhash64("ids")).drop("ids")
