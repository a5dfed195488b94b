"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are its characters; an agenda of adjacent pairs, ordered by the score of the piece that a pair makes and
then by place, says which pair is merged next. No piece holds two characters that stand side by side in none, so texts are
cut into chunks there (a run of blanks and one of letters or of signs), and each distinct chunk is encoded once a worker.
Short chunks share one agenda, held in arrays: a round takes the first pair of each. A long chunk has a heap of its own.
In every Arrow batch, all chunks met for the first time are encoded by the sentencepiece library too; a
difference ends the job. Decoding is the library's.

Nulls and edges: a null or empty text has no ids and decodes to the empty text; texts of any length are taken whole;
repeated rows and null doc_ids stay rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import released, slices

BLANK = "▁"
#: Chunks that a worker keeps; the table starts anew when it is full, which changes no result.
CACHE_CHUNKS = 1_000_000
#: Chunks of up to this many symbols share the agenda in arrays; longer ones take a heap, which any length is fit for.
SHORT = 48
_NEVER = np.int64(1) << np.int64(62)
_OPEN: dict[str, "PieceCodec"] = {}


class PieceCodec:
    """Ids of texts by one vocabulary file. Takes merge-type (BPE) models without pieces that users defined or that are marked unused."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids):
            raise ValueError("unused pieces are not handled")
        self.pieces = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in ids) else None
        self.unknown, self.size = sp.unk_id(), len(ids)
        # symbols: pieces, and characters that are part of one without being one themselves
        self.symbols = dict(self.pieces)
        for piece in self.pieces:
            for c in piece:
                self.symbols.setdefault(c, len(ids) + len(self.symbols))
        self.by_code = np.full(0x110000, -1, np.int64)  # of characters
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.by_code[ord(c)] = i
        # a pair of symbols makes a piece; equal scores have equal ranks, so that the first place wins
        scores = sorted({sp.get_score(i) for i in self.pieces.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        made = {}
        for piece, i in self.pieces.items():
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    made[a << 32 | b] = (rank[sp.get_score(i)], i)
        self.made = made
        self.keys = np.array(sorted(made), np.int64)
        self.ranks = np.array([made[k][0] for k in self.keys.tolist()] + [0], np.int64)
        self.merged = np.array([made[k][1] for k in self.keys.tolist()] + [0], np.int64)
        beside = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        if any(b == BLANK != a for a, b in beside):
            raise ValueError("pieces with a blank inside are not handled")
        # characters that adjoin in pieces, directly or over others, form a class; no piece holds two of different classes
        kind = {c: c for p in beside for c in p if c != BLANK}

        def top(c: str) -> str:
            while kind[c] != c:
                c = kind[c]
            return c

        for a, b in beside:
            if a != BLANK:
                kind[top(b)] = top(a)
        classes: dict[str, list[str]] = {}
        for c in kind:
            classes.setdefault(top(c), []).append(c)
        runs = [f"{BLANK}*[{re.escape(''.join(c))}]+" for c in sorted(classes.values(), key=len, reverse=True)]
        self.chunks = re.compile("|".join([*runs, f"{BLANK}*[^{BLANK}]", f"{BLANK}+"])).findall
        self.lines = "\n" not in kind  # no piece reaches over a line end
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str) -> "PieceCodec":
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def _spelled(self, symbols: list[int], text: str) -> tuple[int, ...]:
        """The ids of final symbols; characters that are no piece are spelled in bytes where the vocabulary has them."""
        out, at = [], 0
        for s in symbols:
            known = 0 <= s < self.size
            if known:
                out.append(s)
            elif self.bytes:
                out += [self.bytes[b] for b in text[at].encode()]
            else:
                out.append(self.unknown)
            at += len(self.library.id_to_piece(s)) if known else 1
        return tuple(out)

    def by_heap(self, symbols: list[int]) -> list[int]:
        """One chunk's final symbols."""
        sym, n, made = list(symbols), len(symbols), self.made
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))

        def pair(i: int):
            j = right[i]
            found = made.get(sym[i] << 32 | sym[j]) if j < n and sym[i] >= 0 <= sym[j] else None
            return found and (found[0], i, j, sym[i], sym[j], found[1])

        agenda = [p for p in map(pair, range(n - 1)) if p]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, a, b, piece = heapq.heappop(agenda)
            if sym[i] != a or sym[j] != b or right[i] != j:  # one of the two was merged meanwhile
                continue
            sym[i], sym[j], right[i] = piece, -2, right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(agenda, p)
        return [s for s in sym if s != -2]

    def _looked_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs; _NEVER where they make none."""
        key = a << np.int64(32) | b
        at = np.searchsorted(self.keys, key)
        hit = (a >= 0) & (b >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(a), bool)
        at = np.where(hit, at, len(self.keys))
        return np.where(hit, self.ranks[at], _NEVER), self.merged[at]

    def by_rounds(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The final symbols of many chunks: in each round, the first pair of every chunk's agenda is merged."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        sym = self.by_code[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        own = np.repeat(np.arange(len(chunks)), size)
        rank, piece = np.full(len(sym), _NEVER), np.zeros(len(sym), np.int64)
        pair = np.flatnonzero(own[:-1] == own[1:])
        rank[pair], piece[pair] = self._looked_up(sym[pair], sym[pair + 1])
        done = []
        while True:
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            best = np.minimum.reduceat(rank, start)
            over = np.repeat(best == _NEVER, size)
            done.append((own[over], sym[over]))
            if over.all():
                break
            # the first place that has the best rank
            at = np.flatnonzero((rank == np.repeat(best, size)) & ~over)
            at = at[np.r_[True, own[at[1:]] != own[at[:-1]]]]
            sym[at], rank[at] = piece[at], _NEVER
            keep = ~over
            keep[at + 1] = False  # is part of the piece now
            at = np.cumsum(keep)[at] - 1
            sym, own, rank, piece = sym[keep], own[keep], rank[keep], piece[keep]
            new = np.concatenate([at, at[at > 0] - 1])
            new = new[new + 1 < len(sym)]
            new = new[own[new] == own[new + 1]]
            rank[new], piece[new] = self._looked_up(sym[new], sym[new + 1])
        own, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(own, kind="stable")
        ends = np.cumsum(np.bincount(own, minlength=len(chunks))).tolist()
        flat = sym[order].tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _encode_new(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        short, out = sorted((c for c in new if len(c) <= SHORT), key=len), {}
        for at in range(0, len(short), 4000):  # of like lengths, so that they end in like rounds
            some = short[at : at + 4000]
            out |= zip(some, self.by_rounds(some), strict=True)
        for c in new:
            if len(c) > SHORT:
                out[c] = tuple(self.by_heap([self.symbols.get(x, -1) for x in c]))
        odd = [c for c, ids in out.items() if min(ids) < 0 or max(ids) >= self.size]
        return out | {c: self._spelled(out[c], c) for c in odd}

    def _check(self, found: dict[str, tuple[int, ...]]) -> None:
        """The library's ids of the same chunks, a few hundred at a time as lines of one text."""
        names, before = list(found), len(self.library.encode("\n"))
        line = tuple(self.library.encode("\n\n")[before:])
        for at in range(0, len(names), 300):
            some = names[at : at + 300]
            own = list(chain.from_iterable(line + found[c] for c in some))
            theirs = self.library.encode("\n" + "\n".join(some))[before - len(line) :]
            if own != theirs and self._collapsed(own) != theirs:
                raise RuntimeError(f"ids differ from the library's in {some!r:.2000}")

    def _collapsed(self, ids: list[int]) -> list[int]:
        """Without byte pieces, unknown characters in a row share one id."""
        return ids if self.bytes else [x for i, run in groupby(ids) for x in ([i] if i == self.unknown else run)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        chunked = [self.chunks(self.library.normalize(t)) if t else [] for t in texts]
        new = list(set().union(*chunked) - self.cache.keys())
        look = self.cache
        if new:
            made = self._encode_new(new)
            if self.lines:
                self._check(made)
            if len(self.cache) + len(made) > CACHE_CHUNKS:
                look, self.cache = self.cache | made, made if len(made) <= CACHE_CHUNKS else {}
            else:
                self.cache.update(made)
        out = [self._collapsed(list(chain.from_iterable(map(look.__getitem__, c)))) for c in chunked]
        if not self.lines and out != self.library.encode(texts):
            raise RuntimeError("ids differ from the library's")
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(batches):
    for whole in batches:
        yield from slices(whole, "text", 256, 1 << 20)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""
    path = path or piece_model()

    def run(batches):
        codec = PieceCodec.of(path)
        for b in _texts(batches):
            ids = codec.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _given(docs).mapInArrow(released(run), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: what ``ids`` decode to; null ids to null."""
    path = path or piece_model()

    def run(batches):
        codec = PieceCodec.of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                ids = b.column("ids").to_pylist()
                text = codec.decode([x or [] for x in ids])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if i is None else t for i, t in zip(ids, text)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(released(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encoding and decoding make of every text, in one pass."""
    path = path or piece_model()

    def run(batches):
        codec = PieceCodec.of(path)
        name = [str(i) for i in range(codec.library.get_piece_size())].__getitem__
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in _texts(batches):
            ids = codec.encode([t or "" for t in b.column("text").to_pylist()])
            cols = [b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([sha(",".join(map(name, i))) for i in ids], pa.string()), pa.array(map(sha, codec.decode(ids)), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _given(docs).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _given(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def op12_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents, by the 32,000 pieces of the public vocabulary."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
