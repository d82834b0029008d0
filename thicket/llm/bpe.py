"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from thicket.llm.common import short_batches, slices, table

#: Bytes of stretches and their ids that a worker remembers; bounds its memory, never the result.
REMEMBERED = 48 << 20
#: Bytes that Python's strings and dicts take for one remembered stretch besides its characters.
EACH = 200


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the pair of least rank, leftmost first, is merged until no pair has a rank.

    A segment tree over byte positions holds (rank, position) of the pair that starts there, its root the next merge. A merge changes two leaves and empties one, each a climb of log n. A piece that is itself a token is that token.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << max(n - 1, 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # where the live token at a position ends
    start = list(range(-1, n))  # where the live token that ends at a position's left starts; by the token's end

    def put(i: int, v: int) -> None:
        k = size + i
        tree[k] = v
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            v = a if a < b else b
            if tree[k] == v:
                break
            tree[k] = v

    while (low := tree[1]) != none:
        i = low & 0xFFFFFFFF
        j = end[i]  # the right token, which goes
        e = end[i] = end[j]
        start[e] = i
        put(j, none)
        r = get(piece[i : end[e]]) if e < n else None
        put(i, none if r is None else r << 32 | i)
        if i:
            h = start[i]
            r = get(piece[h:e])
            put(h, none if r is None else r << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys left << 32 | right of all pairs of tokens that make a token, and the ids of these."""
    pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
    keys = np.array(sorted(pairs), np.int64)
    return keys, np.array([pairs[k] for k in keys.tolist()], np.int64)


def merge_pieces(pieces: list[bytes], of_byte: np.ndarray, keys: np.ndarray, made: np.ndarray) -> tuple[list[int], list[int]]:
    """merge_piece for many short pieces at once: a segment tree a row, one merge of every row a turn. A token's id is its rank. Returns the ids of all pieces, and where each piece's end."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    width = int(n.max())
    size = 1 << max(width - 1, 1).bit_length()
    none = np.int64(1 << 62)
    raw = np.zeros((len(pieces), width), np.uint8)
    raw[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    tok = of_byte[raw]
    live = np.arange(width) < n[:, None]
    end = np.minimum(np.arange(1, width + 1), n[:, None])
    start = np.broadcast_to(np.arange(-1, width), (len(pieces), width + 1)).copy()
    tree = np.full((len(pieces), 2 * size), none)

    def ranked(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[k] == key, made[k] << 16 | at, none)

    r, i = np.nonzero(live[:, 1:])
    tree[r, size + i] = ranked(tok[r, i], tok[r, i + 1], i)
    for lo in (size >> s for s in range(1, size.bit_length())):
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    rows = np.flatnonzero(tree[:, 1] != none)
    while len(rows):
        low = tree[rows, 1]
        i, new = low & 0xFFFF, low >> 16
        j = end[rows, i]
        e = end[rows, j]
        end[rows, i] = e
        start[rows, e] = i
        tok[rows, i] = new
        live[rows, j] = False
        tree[rows, size + j] = none
        more = e < n[rows]
        after = ranked(new, tok[rows, np.minimum(e, width - 1)], i)
        tree[rows, size + i] = np.where(more, after, none)
        h = start[rows, i]
        left = i > 0
        hr, hh = rows[left], h[left]
        tree[hr, size + hh] = ranked(tok[hr, hh], new[left], hh)
        for r, k in ((rows, size + j), (rows, size + i), (hr, size + hh)):
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
        rows = rows[tree[rows, 1] != none]
    return tok[live].tolist(), np.cumsum(live.sum(1)).tolist()


def matcher(pattern: str):
    """The pattern compiled so that white space is the Unicode property, as in the library that defines the rank files."""
    import regex

    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def parsed(rank_file: bytes) -> dict[bytes, int]:
    """The ranks in the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}


class Codec:
    """Encoder and decoder of one vocabulary. rank_file: the lines of a rank file; pattern: what splits texts; table: its pair_table(), if made before.

    Ids are remembered by the stretch from one single space to the next: the patterns take a space only at the start of a piece, so a text may be cut before a space between two characters that aren't white space, and each stretch be matched by itself. Texts with other spaces are matched whole. Stretches are remembered in two halves: when the young half is full it becomes the old one, which is forgotten but for what is used again meanwhile.
    """

    def __init__(self, rank_file: bytes, pattern: str, table: tuple | None = None, remembered: int = REMEMBERED):
        self.ranks = parsed(rank_file)
        self.vocab = {str(v): k for k, v in self.ranks.items()}
        self.said = {v: f" {v}" for v in self.ranks.values()}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.table = table or pair_table(self.ranks)
        self.pieces = matcher(pattern).findall
        self.young: dict[str, str | None] = {}
        self.old: dict[str, str | None] = {}
        self.size, self.most = 0, remembered // 2

    def learnt(self, pieces: set[str]) -> dict[str, str]:
        """The ids of pieces, decimal, a space before each."""
        known: dict[str, str] = {}
        by_width: dict[int, list[str]] = {}
        said, ranks = self.said.__getitem__, self.ranks.get
        for p in pieces:
            raw = p.encode()
            if (r := ranks(raw)) is not None:
                known[p] = said(r)
            elif len(raw) > 64:
                known[p] = "".join(map(said, merge_piece(raw, self.ranks)))
            else:
                by_width.setdefault((len(raw) + 3) // 4, []).append(p)
        for group in by_width.values():
            for k in range(0, len(group), 20_000):
                part = group[k : k + 20_000]
                flat, ends = merge_pieces([p.encode() for p in part], self.of_byte, *self.table)
                ids, first = list(map(said, flat)), 0
                for p, end in zip(part, ends, strict=True):
                    known[p] = "".join(ids[first:end])
                    first = end
        return known

    def join(self, split: list[list[str]]) -> list[str]:
        """The ids of texts given as their pieces."""
        get = self.learnt(set().union(*split)).__getitem__
        return ["".join(map(get, x)) for x in split]

    def recall(self, stretches: set[str]) -> None:
        """Sees to it that the young half holds all these stretches."""
        young, old = self.young, self.old
        lacking = stretches.difference(young)
        again = {p: old[p] for p in lacking if p in old}
        new = [p for p in lacking if p not in again]
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        # matched as one text: each space in it begins a stretch
        pieces = self.pieces("".join([" " + p for p in plain]))
        ids = list(map(self.learnt(set(pieces)).__getitem__, pieces))
        begins = [i for i, p in enumerate(pieces) if p[0] == " "]
        again.update(dict.fromkeys(new))
        again.update((p, ids[i] if j == i + 1 else "".join(ids[i:j])) for p, i, j in zip(plain, begins, [*begins, len(ids)][1:], strict=True))
        young.update(again)
        self.size += sum(map(len, again)) + sum([len(v) for v in again.values() if v]) + EACH * len(again)

    def forget(self) -> None:
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0

    def encode_batch(self, texts: list[str], at_once: int = 1_000_000) -> Iterator[str]:
        """The ids of each text, decimal, a space before each. Works over some `at_once` characters at a time."""
        k = 0
        while k < len(texts):
            parts, chars = [], 0
            while k < len(texts) and (not parts or chars < at_once):
                parts.append(texts[k].split(" "))
                chars += len(texts[k])
                k += 1
            self.forget()
            self.recall(set().union(*(x[1:] for x in parts)))
            get = self.young.__getitem__
            heads = self.join([self.pieces(x[0]) for x in parts])
            for head, x in zip(heads, parts, strict=True):
                try:
                    if len(x) > 1 and (not x[0] or x[0][-1].isspace()):
                        raise TypeError
                    rest = "".join(map(get, x[1:]))
                except TypeError:  # None: white space beside a space
                    yield self.join([self.pieces(" ".join(x))])[0]
                else:
                    yield head + rest

    def encode(self, text: str) -> list[int]:
        return list(map(int, next(self.encode_batch([text])).split()))

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, map(str, ids)))


def read_ranks(path: str) -> bytes:
    """A rank file, read on the driver and sent to executors; its size is that of a vocabulary, about 1 MB."""
    with open(path, "rb") as f:
        return f.read()


def _per_text(docs: DataFrame, rank_file: bytes, pattern: str, of: Callable[[Codec, str, str], tuple], names: list[str], types: str) -> DataFrame:
    """docs without text, with the columns that `of` makes of the ids (as encode_batch gives them) and the text of each row. A worker holds a few MB of texts and their ids at a time."""
    short_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text" and c not in names]
    sent = docs.sparkSession.sparkContext.broadcast((rank_file, pair_table(parsed(rank_file))))  # its size is the vocabulary's
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*[f"`{c}`" for c in rest]).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, pairs = sent.value
        codec = Codec(file, pattern, pairs)
        kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}
        for whole in batches:
            for b in slices(whole, "text"):
                texts = [t or "" for t in b.column("text").to_pylist()]
                made = [of(codec, x, t) for x, t in zip(codec.encode_batch(texts), texts, strict=True)]
                kept = [b.column(c) for c in rest]
                cols = [pa.array([m[i] for m in made], kinds[t.split(" ")[1]]) for i, t in enumerate(types.split(", "))]
                yield pa.RecordBatch.from_arrays(kept + cols, names=rest + names)

    return docs.select(*[f"`{c}`" for c in rest], "text").mapInArrow(run, ", ".join(x for x in (fields, types) if x))


def encode(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """docs with `text` replaced by `ids` array<int> and `n_tokens` long. Null texts count as empty and have no tokens; every other column stays, but for those named ids or n_tokens."""
    return _per_text(docs, rank_file, pattern, lambda c, x, t: ((ids := np.fromstring(x, np.int32, sep=" ")), len(ids)), ["ids", "n_tokens"], "ids array<int>, n_tokens long")


def tokenised(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """encode(), with `round_trip`: whether the ids decode to the text."""

    def of(codec: Codec, ids: str, text: str) -> tuple:
        return (got := np.fromstring(ids, np.int32, sep=" ")), len(got), codec.decode_text(ids) == text.encode()

    return _per_text(docs, rank_file, pattern, of, ["ids", "n_tokens", "round_trip"], "ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """encoded with `ids` replaced by the `bytes` they stand for; null ids give no bytes."""
    rest = [c for c in encoded.columns if c not in ("ids", "bytes")]
    sent = encoded.sparkSession.sparkContext.broadcast(rank_file)
    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.select(*rest).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = {int(b): base64.b64decode(a) for a, b in map(bytes.split, sent.value.splitlines())}
        for b in batches:
            made = pa.array([b"".join(map(vocab.__getitem__, x.as_py() or [])) for x in b.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], made], names=[*rest, "bytes"])

    return encoded.select(*rest, "ids").mapInArrow(run, ", ".join(x for x in (fields, "bytes binary") if x))


def digests(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """docs with `text` replaced by n_tokens, ids_sha256 and decoded_sha256: encoded, decoded and digested in one pass, so that the ids needn't leave the worker. Null and empty texts have no tokens and the digests of nothing; repeated rows are alike; columns with these names give way."""

    def of(codec: Codec, ids: str, text: str) -> tuple:
        return ids.count(" "), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(codec.decode_text(ids)).hexdigest()

    return _per_text(docs, rank_file, pattern, of, ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The contract's digests of every document, by digests()."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), read_ranks(public_tokenizers.path(ranks)), public_tokenizers.PATTERN)
