"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary is that of a merge-type (BPE) model file; nothing is trained. Encoding starts from single
characters (a space is the piece mark, one is put before a text that has any character) and takes, again
and again, the adjacent pair whose joined piece has the best score, the leftmost of equals. Every candidate
merge is first put to a keyed hash of (seed, document key, the unit's place in the document, the merge's start, middle
and end in the unit): below `dropout` of the hash space it is skipped for good. Each occurrence of a unit draws its
own. With dropout 0 the result is that of the public library.

No piece joins a character with a following space, so texts are cut into units (spaces and what follows up to
the next space or line feed), which are encoded independently. What a unit gives without skips is kept from one to
the next, with the merges taken: an occurrence that skips none of these gives the same. All others are merged anew. Units up to LONG characters are merged together in numpy, all at once; longer ones, of any length, one by one
with a heap.

Decoding joins the pieces' bytes and takes the first space away. Characters without a piece, and the piece mark
itself where it stands in a text, become byte pieces: every text decodes to itself.

Edge cases: null gives null, an empty text no ids. A null key counts as 0. The memory of a worker is bounded by
KEPT units besides one batch. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .storage import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 20240229
LONG, KEPT = 48, 250_000
MARK = "▁"
_UNIT = re.compile(r" *[^ \n]+|\n| +")
_NEVER = np.iinfo(np.int32).max
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass
class Vocabulary:
    """pieces: the bytes each id decodes to; chars: ids of single characters; bytes_: ids of the byte pieces.

    pairs, joined, rank: sorted (left << 32 | right) keys, the id they join to, and its place by score.
    """

    pieces: list[bytes]
    chars: dict[str, int]
    bytes_: np.ndarray
    pairs: np.ndarray
    joined: np.ndarray
    rank: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        bytes_ = np.full(256, -1, np.int32)
        out = []
        for i in ids:
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(name[1:-1], 16)] = i
                out.append(bytes([int(name[1:-1], 16)]))
            else:
                out.append(name.replace(MARK, " ").encode() if name in plain else b"")
        if (bytes_ < 0).any():
            raise ValueError("the model has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("the model has pieces that span a space")
        symbol = dict(plain)
        for p in plain:
            for c in p:
                symbol.setdefault(c, len(out) + len(symbol))  # a character that has no piece of its own, but is part of some
        order = {i: k for k, (_, i) in enumerate(sorted((-sp.get_score(i), i) for i in plain.values()))}
        found = sorted((symbol[p[:k]] << 32 | symbol[p[k:]], i, order[i]) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        keys, joined, rank = (np.array(x) for x in zip(*found))
        chars = {c: i for c, i in symbol.items() if len(c) == 1 and c != MARK}
        chars[" "] = symbol[MARK]
        return cls(out, chars, bytes_, keys.astype(np.uint64), joined.astype(np.int32), rank.astype(np.int32))


def _place(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of a candidate's place in its unit."""
    return tc.mix(start.astype(np.uint64) * _A ^ mid.astype(np.uint64) * _B ^ end.astype(np.uint64) * _C)


@dataclass
class Encoder:
    vocabulary: Vocabulary
    dropout: float = DROPOUT
    seed: int = SEED
    known: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._forget()
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, i in self.vocabulary.chars.items():
            self.symbol[ord(c)] = i
        self.maybe = np.zeros(1 << 20, bool)  # by 20 bits of a pair's hash: most pairs that don't join stop here
        self.maybe[(self.vocabulary.pairs * _A >> np.uint64(44)).astype(np.int64)] = True
        self.limit = np.uint64(min(int(self.dropout * 2**64), 2**64 - 1))

    def _rank(self, left: np.ndarray, right: np.ndarray, key: np.ndarray | None, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place by score of each candidate (never: no such piece, or skipped) and the id it joins to."""
        v = self.vocabulary
        pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        some = np.flatnonzero(self.maybe[(pair * _A >> np.uint64(44)).astype(np.int64)] & (left >= 0) & (right >= 0))
        pair = pair[some]
        at = np.minimum(np.searchsorted(v.pairs, pair), len(v.pairs) - 1)
        good = v.pairs[at] == pair
        if self.limit and key is not None:
            good &= tc.mix(key[some] ^ _place(start[some], mid[some], end[some])) >= self.limit
        rank, joined = np.full(len(left), _NEVER, np.int32), np.zeros(len(left), np.int32)
        rank[some[good]], joined[some[good]] = v.rank[at[good]], v.joined[at[good]]
        return rank, joined

    def _forget(self) -> None:
        """No unit is known: known has their numbers; plain, first, count and taken what they give without skips and the merges taken."""
        self.known, self.plain = {}, []
        self.first, self.count, self.taken = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _out(self, unit: str, symbols: list[int], starts: list[int]) -> bytes:
        ids: list[int] = []
        n = len(self.vocabulary.pieces)
        for s, a in zip(symbols, starts):
            if 0 <= s < n:
                ids.append(s)
            else:
                ids.extend(self.vocabulary.bytes_[list(unit[a].encode())].tolist())
        return np.array(ids, np.int32).tobytes()

    def encode_long(self, unit: str, key: int | None) -> bytes:
        """One unit of any length, with a heap of candidates. key: of the occurrence; None: no skips."""
        sym = self.symbol[np.frombuffer(unit.encode("utf-32-le"), np.uint32)].tolist()  # below 0: no piece
        n, keys = len(unit), None if key is None else np.array([key], np.uint64)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def put(i: list[int]) -> None:
            i = [x for x in i if x >= 0 and nxt[x] < n]
            if not i:
                return
            a = np.array(i)
            m = np.array([nxt[x] for x in i])
            e = np.array([nxt[nxt[x]] for x in i])
            r, j = self._rank(np.array([sym[x] for x in i]), np.array([sym[x] for x in m.tolist()]), None if keys is None else np.repeat(keys, len(i)), a, m, e)
            for k in np.flatnonzero(r != _NEVER):
                heapq.heappush(heap, (int(r[k]), i[k], int(m[k]), int(e[k]), int(j[k])))

        put(list(range(n - 1)))
        while heap:
            _, i, m, e, j = heapq.heappop(heap)
            if not (alive[i] and nxt[i] == m and m < n and alive[m] and nxt[m] == e):
                continue
            sym[i], nxt[i], alive[m] = j, e, False
            if e < n:
                prv[e] = i
            put([prv[i], i])
        at = [i for i in range(n) if alive[i]]
        return self._out(unit, [sym[i] for i in at], at)

    def encode_many(self, units: list[str], key: np.ndarray | int | None, taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[bytes]:
        """Units of at most LONG characters, all merged side by side. key: of the occurrences; None: no skips. taken gets (unit, place hash) of the merges."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        width = int(sizes.max())
        count = len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        flat = self.symbol[codes]
        row = np.repeat(np.arange(count), sizes)
        first = np.cumsum(sizes) - sizes
        col = np.arange(len(flat)) - first[row]
        keys = None if key is None else np.broadcast_to(np.asarray(key, np.uint64), count)

        def put(t: np.ndarray, a: np.ndarray, m: np.ndarray, e: np.ndarray) -> None:
            rank[t, a], joined[t, a] = self._rank(sym[t, a], sym[t, m], None if keys is None else keys[t], a, m, e)

        sym = np.full((count, width + 1), -1, np.int32)
        sym[row, col] = flat
        nxt = np.tile(np.arange(1, width + 2, dtype=np.int32), (count, 1))
        prv = np.tile(np.arange(-1, width, dtype=np.int32), (count, 1))
        rank = np.full((count, width), _NEVER, np.int32)
        joined = np.zeros((count, width), np.int32)
        inner = col < sizes[row] - 1
        r, c = row[inner], col[inner]
        put(r, c, c + 1, c + 2)
        todo = np.arange(count)
        while len(todo):
            best = rank[todo].argmin(1)
            some = rank[todo, best] != _NEVER
            todo, i = todo[some], best[some]
            if not len(todo):
                break
            m = nxt[todo, i]
            e = nxt[todo, m]
            if taken is not None:
                taken.append((todo, _place(i, m, e)))
            sym[todo, i] = joined[todo, i]
            nxt[todo, i] = e
            sym[todo, m] = -2
            rank[todo, m[:]] = _NEVER
            size = sizes[todo]
            inside = e < size
            prv[todo[inside], e[inside]] = i[inside]
            rank[todo, i] = _NEVER
            t, a, b = todo[inside], i[inside], e[inside]
            put(t, a, b, nxt[t, b])
            before = prv[todo, i]
            has = before >= 0
            t, a, b = todo[has], before[has], i[has]
            put(t, a, b, nxt[t, b])
        left = sym[row, col]
        stays = left != -2
        row, col, left = row[stays], col[stays], left[stays]
        plain = (left >= 0) & (left < len(self.vocabulary.pieces))
        ids = left.astype(np.int32)
        per = np.bincount(row, minlength=count)
        ends = np.cumsum(per)
        mixed = np.zeros(count, bool)
        mixed[row[~plain]] = True
        raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        out = [raw[x:y] for x, y in zip(bounds, bounds[1:])]
        for k in np.flatnonzero(mixed).tolist():
            x, y = bounds[k] // 4, bounds[k + 1] // 4
            out[k] = self._out(units[k], left[x:y].tolist(), col[x:y].tolist())
        return out

    def _learn(self, units: list[str]) -> None:
        """Keep what units give without skips. Long ones get no merges: they are merged anew where skips are drawn."""
        units = sorted(units, key=len)
        short = bisect.bisect_right(units, LONG, key=len)
        for i in range(0, short, 20_000):
            part, taken = units[i : min(short, i + 20_000)], []
            self.plain.extend(self.encode_many(part, None, taken if self.limit else None))
            t, place = (np.concatenate(x) for x in zip(*taken)) if taken else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            self._append(np.bincount(t, minlength=len(part)), place[np.argsort(t, kind="stable")])
        for unit in units[short:]:
            self.plain.append(b"" if self.limit else self.encode_long(unit, None))
        self._append(np.zeros(len(units) - short, np.int64), np.zeros(0, np.uint64))
        self.known.update(zip(units, range(len(self.known), len(self.plain))))

    def _append(self, count: np.ndarray, place: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.taken) + np.cumsum(count) - count])
        self.count, self.taken = np.concatenate([self.count, count]), np.concatenate([self.taken, place])

    def _skips(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which occurrences (number of the unit, key) skip a merge that the unit takes without skips: the others change nothing."""
        count = self.count[at]
        ends = np.cumsum(count)
        place = self.taken[np.repeat(self.first[at] - ends + count, count) + np.arange(int(count.sum()))]
        total = np.concatenate([[0], np.cumsum(tc.mix(np.repeat(keys, count) ^ place) < self.limit)])
        return total[ends] > total[ends - count]

    def keys_of(self, key: int, n: int) -> np.ndarray:
        """Keys of the n units of a document."""
        return tc.mix(tc.mix(np.arange(n, dtype=np.uint64) + np.uint64((key * 0x9E3779B97F4A7C15 + self.seed) % 2**64)))

    def encode(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray | None]:
        """Ids of some texts. A group of texts of about two chunks is looked up together."""
        out: list[np.ndarray | None] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < 2 * tc.CHUNK_BYTES):
                size += len(texts[j] or "")
                j += 1
            if len(self.known) > KEPT:
                self._forget()
            own = [_UNIT.findall(" " + t) if t else [] for t in texts[i:j]]
            units = list(itertools.chain.from_iterable(own))
            missing = set(units) - self.known.keys()
            if missing:
                self._learn(list(missing))
            numbers = list(map(self.known.__getitem__, units))
            got = list(map(self.plain.__getitem__, numbers))
            if self.limit and units:
                occurrence = np.concatenate([self.keys_of(k, len(u)) for k, u in zip(keys[i:j], own)])
                at = np.array(numbers, np.int64)
                again = np.concatenate([k + np.flatnonzero(self._skips(at[k : k + 50_000], occurrence[k : k + 50_000])) for k in range(0, len(at), 50_000)])
                sizes = np.fromiter(map(len, units), np.int64, len(units))
                again = again[np.argsort(sizes[again], kind="stable")]
                for k in range(0, len(again), 20_000):
                    part = again[k : k + 20_000]
                    for x, ids in zip(part.tolist(), self.encode_many([units[x] for x in part.tolist()], occurrence[part])):
                        got[x] = ids
                for x in np.flatnonzero(sizes > LONG).tolist():
                    got[x] = self.encode_long(units[x], int(occurrence[x]))
            done = 0
            for text, u in zip(texts[i:j], own):
                out.append(None if text is None else np.frombuffer(b"".join(got[done : done + len(u)]), np.int32))
                done += len(u)
            i = j
        return out


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    raw = b"".join(map(vocabulary.pieces.__getitem__, ids))
    return raw[1:].decode() if raw[:1] == b" " else raw.decode()


def _list_of(ids: list[np.ndarray | None]) -> pa.Array:
    flat = np.concatenate([x for x in ids if x is not None]) if any(x is not None for x in ids) else np.zeros(0, np.int32)
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids], pa.bool_()))


def encoder(vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
    """A column function (text, key) -> ids."""
    state: dict[str, Encoder] = {}

    def encode(text: pa.Array, key: pa.Array) -> pa.Array:
        if "encoder" not in state:
            state["encoder"] = Encoder(vocabulary, dropout, seed)
        ids = state["encoder"].encode(text.to_pylist(), [x or 0 for x in key.to_pylist()])
        out = _list_of(ids)
        tc.relax()
        return out

    return F.arrow_udf(encode, "array<int>").asNondeterministic()


def decoder(vocabulary: Vocabulary):
    """A column function ids -> text."""

    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else decode_ids(vocabulary, x) for x in (y.values.to_numpy().tolist() if y.is_valid else None for y in ids)], pa.string())

    return F.arrow_udf(decode, "string").asNondeterministic()


def round_tripper(vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
    """A column function (text, key) -> struct of ids and what they decode to, in one worker."""
    state: dict[str, Encoder] = {}

    def both(text: pa.Array, key: pa.Array) -> pa.Array:
        if "encoder" not in state:
            state["encoder"] = Encoder(vocabulary, dropout, seed)
        ids = state["encoder"].encode(text.to_pylist(), [x or 0 for x in key.to_pylist()])
        back = pa.array([None if x is None else decode_ids(vocabulary, x.tolist()) for x in ids], pa.string())
        out = pa.StructArray.from_arrays([_list_of(ids), back], ["ids", "decoded"])
        tc.relax()
        return out

    return F.arrow_udf(both, "ids array<int>, decoded string").asNondeterministic()


def with_round_trip(spark: SparkSession, docs: DataFrame, model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs with ids and decoded; as with_pieces and with_text one after the other, with half the workers."""
    ship(spark)
    both = docs.withColumn("__both", round_tripper(Vocabulary.load(model), dropout, seed)(F.col("text"), F.col("doc_id").cast("long")))
    return both.withColumns({"ids": F.col("__both.ids"), "decoded": F.col("__both.decoded")}).drop("__both")


def with_pieces(spark: SparkSession, docs: DataFrame, name: str = "ids", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs with the ids of their texts."""
    ship(spark)
    return docs.withColumn(name, encoder(Vocabulary.load(model), dropout, seed)(F.col("text"), F.col("doc_id").cast("long")))


def with_text(spark: SparkSession, df: DataFrame, ids: str = "ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """df with the texts that the ids decode to."""
    ship(spark)
    return df.withColumn(name, decoder(Vocabulary.load(model))(F.col(ids)))


def digest(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns named, n_tokens, ids_sha256 (of the ids, comma-joined), decoded_sha256 and whether the text came back."""
    return df.select(
        "doc_id",
        *more,
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<int>")), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(with_round_trip(spark, docs))
