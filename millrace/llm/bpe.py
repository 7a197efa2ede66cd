"""BPE encoding and decoding with a byte-level vocabulary.

Each pre-token is merged over a contiguous rank array: its part boundaries stand in one list and the rank of each
adjacent pair in another; the least rank is found by scanning, that boundary is deleted, and the two neighbouring ranks
are looked up again.  Scanning is quadratic, so pre-tokens of over SHORT bytes keep the same ranks in a heap over
linked boundaries instead, with the same result.  Pre-tokens that are new in a slice are merged together, the rank
array of each a row of a matrix.  A bounded cache holds the ids of recent pre-tokens.

Defined results: null text counts as empty, giving no ids and empty text; rows are taken one by one, so that repeated
rows give repeated results; other columns are not looked at."""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import slices, table

#: Fixed value of the vocabulary: how a byte-level tokenizer cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 128
CACHE = 1 << 19
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def merge_short(word: bytes, ranks: dict) -> list[bytes]:
    """Parts of a word: contiguous boundaries and ranks, least rank first, leftmost on ties."""
    at = list(range(len(word) + 1))
    rank = [ranks.get((word[i : i + 1], word[i + 1 : i + 2]), _NONE) for i in range(len(word) - 1)]
    while rank:
        least = min(rank)
        if least == _NONE:
            break
        i = rank.index(least)
        del at[i + 1]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get((word[at[i] : at[i + 1]], word[at[i + 1] : at[i + 2]]), _NONE)
        if i:
            rank[i - 1] = ranks.get((word[at[i - 1] : at[i]], word[at[i] : at[i + 1]]), _NONE)
    return [word[a:b] for a, b in zip(at, at[1:])]


def merge_long(word: bytes, ranks: dict) -> list[bytes]:
    """The same parts in n log n: a heap of (rank, left boundary) over linked boundaries; stale entries are skipped."""
    n = len(word)
    after, before, alive = [*range(1, n + 1), n], [-1, *range(n)], [True] * (n + 1)

    def pair(i: int) -> int:
        j = after[i]
        return ranks.get((word[i:j], word[j : after[j]]), _NONE) if j < n else _NONE

    heap = [(r, i) for i in range(n - 1) if (r := pair(i)) != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        if not alive[i] or pair(i) != r:
            continue
        j = after[i]
        alive[j] = False
        after[i] = after[j]
        before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := pair(k)) != _NONE:
                heapq.heappush(heap, (r, k))
    out, i = [], 0
    while i < n:
        out.append(word[i : after[i]])
        i = after[i]
    return out


class Bpe:
    """A vocabulary read from a tokenizers JSON file of the byte-level BPE kind."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        letters = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in doc["model"]["vocab"].items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        named = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.table = [named.get(i, b"") for i in range(max(named) + 1)]
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in self.ranks], np.int64)
        keys = np.array([(self.ids[a] << 32) | self.ids[b] for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}

    def _merge(self, raw: bytes) -> bytes:
        """The ids of one pre-token, packed as little-endian unsigned 32-bit integers."""
        parts = (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        return struct.pack(f"<{len(parts)}I", *(self.ids[p] for p in parts))

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs of ids; _NONE where they don't merge (id -1 never does)."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def _merge_block(self, raw: list[bytes]) -> list[bytes]:
        """What _merge gives for many words of about one length: their rank arrays are the rows of a matrix, and in
        each step every row finds its least rank, deletes that boundary and refreshes the two ranks beside it."""
        width = max(map(len, raw))
        part = np.full((len(raw), width), -1, np.int64)
        for i, w in enumerate(raw):
            part[i, : len(w)] = self.byte_ids[np.frombuffer(w, np.uint8)]
        rank = np.full((len(raw), width), _NONE, np.int64)
        rank[:, :-1] = self._lookup(part[:, :-1], part[:, 1:])
        done: list = [b""] * len(raw)
        row, cols = np.arange(len(raw)), np.arange(width)
        while len(row):
            i = rank.argmin(axis=1)
            each = np.arange(len(row))
            least = rank[each, i]
            if (over := least == _NONE).any():
                for k in np.flatnonzero(over):
                    p = part[k]
                    done[row[k]] = p[p >= 0].astype("<u4").tobytes()
                part, rank, row, i, least = part[~over], rank[~over], row[~over], i[~over], least[~over]
                each = np.arange(len(row))
                if not len(row):
                    break
            part[each, i] = self.merged[least]
            gone = cols[None, :] > i[:, None]
            part[:, :-1] = np.where(gone[:, :-1], part[:, 1:], part[:, :-1])
            part[:, -1] = np.where(gone[:, -1], -1, part[:, -1])
            part[:, -1][i < width - 1] = -1
            gone = cols[None, :] >= i[:, None]
            rank[:, :-1] = np.where(gone[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            here = i < width - 1
            rank[each[here], i[here]] = self._lookup(part[each[here], i[here]], part[each[here], i[here] + 1])
            there = i > 0
            rank[each[there], i[there] - 1] = self._lookup(part[each[there], i[there] - 1], part[each[there], i[there]])
        return done

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens; the short ones go to the cache."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[str]] = {}
        for w in missing:
            n = len(w.encode())
            if n <= 48:
                by_width.setdefault((n + 3) // 4, []).append(w)
            else:
                out[w] = self._merge(w.encode())
        for some in by_width.values():
            for i in range(0, len(some), 20_000):
                part = some[i : i + 20_000]
                out.update(zip(part, self._merge_block([w.encode() for w in part]), strict=True))
        if len(self.cache) + len(out) > CACHE:
            self.cache.clear()
        self.cache.update((w, p) for w, p in out.items() if len(w) <= SHORT)
        return out

    def _pieces(self, text: str) -> list:
        """Pre-tokens as strings, special tokens' packed ids as bytes."""
        if self.cut_special is None or not self.cut_special.search(text):
            return self.cut.findall(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [*self.cut.findall(text[at : m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return out + self.cut.findall(text[at:])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts.  Special tokens' strings become their ids."""
        get = self.cache.get
        out, wait = [], []
        for k, text in enumerate(texts):
            pieces = self._pieces(text)
            got = list(map(get, pieces))
            if None in got:
                wait.append((k, pieces, got))
                out.append(b"")
            else:
                out.append(b"".join(got))
        if wait:
            fresh = self.learn({p for _, pieces, got in wait for p, g in zip(pieces, got) if g is None and isinstance(p, str)})
            for k, pieces, got in wait:
                out[k] = b"".join([g if g is not None else p if isinstance(p, bytes) else fresh[p] for p, g in zip(pieces, got)])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Unknown ids are left out; bytes that are no UTF-8 become U+FFFD."""
        table = self.table
        return b"".join([table[i] if 0 <= i < len(table) else b"" for i in ids]).decode("utf-8", "replace")


_loaded: dict[int, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """One vocabulary is kept by each Python worker, with its cache, from task to task."""
    key = hash(spec)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tokens (the ids), n_tokens, ids_sha256, decoded (the text that the ids give).  `path` names a vocabulary
    file that the driver reads; its fixed size bounds the broadcast."""
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        bpe = loaded(sent.value)
        for batch in slices(batches):
            packed = bpe.encode_all([t or "" for t in batch.column("text").to_pylist()])
            counts = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
            ids = np.frombuffer(b"".join(packed), "<u4")
            at = np.concatenate([[0], np.cumsum(counts)])
            flat = ids.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))),
                    pa.array(counts),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([bpe.decode(flat[a:b]) for a, b in zip(at, at[1:])], pa.string()),
                ],
                names=["id", "tokens", "n_tokens", "ids_sha256", "decoded"],
            )

    return rows.mapInArrow(run, "id long, tokens array<int>, n_tokens long, ids_sha256 string, decoded string")


def op2_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    made = encode_decode(table(spark, sf_dir, "documents"), path or vocabulary_path())
    return made.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the corpus as token ids, with digests of the ids and of the text that they give back."""
    made = encode_decode(docs, vocabulary_path())
    return made.select(F.col("id").alias("doc_id"), "n_tokens", "tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
