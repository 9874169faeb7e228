"""SentencePiece encoding and decoding by suffix-array matching.

A text falls apart where no piece can cross: before the last mark of a run of space marks and around line ends. The
distinct parts of a batch are concatenated and indexed by a suffix array; every piece is searched in it by bisection,
which gives all its occurrences as edges from position to position. The edges are sorted by their end and relaxed: for
each position the one edge survives whose piece may follow the piece that survived at its start. Two pieces may follow
each other if the merges of the byte-pair model never cross their border, so the path found is exactly the model's
segmentation. Characters without piece become byte pieces.

Cases: null and empty texts give no ids; texts are encoded whole; repeated rows each get their ids; an empty table
gives no rows; columns other than id and text are ignored. Decoding returns the text exactly, but for the space mark
U+2581 itself, which comes back as a blank, as the model's normaliser doesn't tell them apart. Control pieces decode
to nothing.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import share, table, tidy

MARK = "▁"
_PARTS = re.compile(f"{MARK}+(?={MARK}[^{MARK}\n])|{MARK}+(?=\n|\\Z)|{MARK}?[^{MARK}\n]+|\n")
_NEVER = np.int64(1) << 40
#: Characters from which a part is gone through by itself rather than beside others.
LONG = 512


@dataclass(frozen=True)
class PieceModel:
    """A byte-pair model: pieces by id, their kinds (1 normal, 2 unknown, 3 control, 6 byte) and scores."""

    pieces: tuple[str, ...]
    kinds: tuple[int, ...]
    scores: tuple[float, ...]
    dummy_prefix: bool = True


def default_model_path(spark: SparkSession | None = None) -> str:
    """Where the session's ``gridlens.sentencepiece.model`` says, else the public vocabulary of this machine."""
    if spark is not None and (named := spark.conf.get("gridlens.sentencepiece.model", None)):
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_model(path: str) -> PieceModel:
    """Reads a SentencePiece model file. Byte-pair models with byte pieces and without normalisation are supported."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    kinds = tuple(p.type for p in proto.pieces)
    if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or kinds.count(6) != 256:
        raise ValueError("only byte-pair models with byte pieces and the identity normaliser are supported")
    if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type == 1):
        raise ValueError("a piece crosses a space mark")
    return PieceModel(tuple(p.piece for p in proto.pieces), kinds, tuple(p.score for p in proto.pieces), norm.add_dummy_prefix)


class Tables:
    """What encoding needs to know of a model, as flat arrays: made once by the driver and sent to the tasks."""

    def __init__(self, model: PieceModel):
        self.size, self.dummy_prefix = len(model.pieces), model.dummy_prefix
        normal = [i for i, k in enumerate(model.kinds) if k == 1]
        id_of = {model.pieces[i]: i for i in normal}
        self.single = {p: i for p, i in id_of.items() if len(p) == 1}
        self.byte_id = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == 6}
        self.runs = sorted((len(p), i) for p, i in id_of.items() if not p.strip(MARK))
        words = [i for i in normal if model.pieces[i].strip(MARK) or model.pieces[i] == MARK]
        self.length = np.array([len(p) for p in model.pieces], dtype=np.int32)
        by_score = sorted(words, key=lambda i: -model.scores[i])
        self.rank = np.full(self.size, _NEVER, dtype=np.int64)
        self.rank[by_score] = np.arange(len(by_score))
        pairs = self._pairs(model.pieces, words, id_of)
        self._splits(model.pieces, words, id_of, pairs)
        self.usable = np.array([i for i in words if self.real[i]], dtype=np.int64)
        spelt = [[ord(c) for c in model.pieces[i]] for i in self.usable.tolist()]
        self.spelling = np.zeros((len(spelt), max(map(len, spelt))), dtype=np.int32)
        for row, points in zip(self.spelling, spelt, strict=True):
            row[: len(points)] = points

    def _pairs(self, pieces: tuple[str, ...], words: list[int], id_of: dict[str, int]) -> dict[int, int]:
        """All (left, right) whose concatenation is a piece, as sorted keys with that piece."""
        found = []
        for i in words:
            p = pieces[i]
            for cut in range(1, len(p)):
                if (a := id_of.get(p[:cut])) is not None and (b := id_of.get(p[cut:])) is not None:
                    found.append((a * self.size + b, i))
        found.sort()
        self.pair_keys = np.array([f[0] for f in found], dtype=np.int64)
        self.pair_to = np.array([f[1] for f in found], dtype=np.int32)
        return dict(found)

    def _splits(self, pieces: tuple[str, ...], words: list[int], id_of: dict[str, int], joined: dict[int, int]) -> None:
        """For each piece, its last merge when encoded alone, when it comes about, and whether it comes about at all."""
        size = self.size
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.born, self.real = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=bool)
        for i in words:
            p = pieces[i]
            parts = [id_of.get(c, -1) for c in p]
            if len(p) == 1:
                self.real[i] = True
                continue
            if -1 in parts:
                continue
            latest = -1
            while len(parts) > 1:
                best = min(((self.rank[m], k, m) for k, ab in enumerate(zip(parts, parts[1:], strict=False)) if (m := joined.get(ab[0] * size + ab[1])) is not None), default=None)
                if best is None:
                    break
                latest = max(latest, int(best[0]))
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
                parts[best[1] : best[1] + 2] = [best[2]]
            if len(parts) == 1:
                self.real[i], self.born[i] = True, latest


class Codec:
    """Encodes; keeps the ids of parts it has met, up to about ``most_bytes`` of memory."""

    def __init__(self, tables: Tables | PieceModel, most_bytes: int = 96 << 20, lot: int = 250_000):
        self.t = t = tables if isinstance(tables, Tables) else Tables(tables)
        self.most, self.lot = most_bytes, lot
        self.cache_keys = np.full(1 << 20, -1, dtype=np.int64)
        self.cache_said = np.zeros(1 << 20, dtype=bool)
        self.lone = np.array([t.single[MARK]], dtype="<i4").tobytes()
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, part: str, ids: bytes) -> None:
        self.known[part] = ids
        self.held += 200 + 2 * len(part) + len(ids)

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.t
        key = a * t.size + b
        at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        return np.where((t.pair_keys[at] == key) & (a >= 0) & (b >= 0), t.rank[t.pair_to[at]], _NEVER)

    def _follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may follow a: going back in time from both whole pieces, no pair at the border was ever due to merge."""
        born, to_left, to_right = self.t.born, self.t.left, self.t.right
        said = np.ones(len(a), dtype=bool)
        left, right = a.copy(), b.copy()
        until_left, until_right = np.full(len(a), _NEVER - 1), np.full(len(a), _NEVER - 1)
        live = np.arange(len(a))
        while len(live):
            x, y = left[live], right[live]
            due = self._merge_rank(x, y)
            # a merge further left goes first when two are of one rank
            cross = (due < until_left[live]) & (due <= until_right[live])
            said[live[cross]] = False
            live = live[~cross]
            x, y = left[live], right[live]
            back = born[x] > born[y]
            done = (born[x] < 0) & (born[y] < 0)
            one, two = live[back & ~done], live[~back & ~done]
            until_left[one], left[one] = born[left[one]], to_right[left[one]]
            until_right[two], right[two] = born[right[two]], to_left[right[two]]
            live = live[~done]
        return said

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As above, with a table of answers; -1 stands for a character without piece or the begin, which merges with nothing."""
        said = np.ones(len(a), dtype=bool)
        ask = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[ask] * self.t.size + b[ask]
        slot = (key * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & np.int64(len(self.cache_keys) - 1)
        hit = self.cache_keys[slot] == key
        said[ask[hit]] = self.cache_said[slot[hit]]
        if not hit.all():
            missed = ask[~hit]
            fresh, inverse = np.unique(key[~hit], return_inverse=True)
            answer = self._follow(fresh // self.t.size, fresh % self.t.size)
            said[missed] = answer[inverse]
            place = (fresh * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & np.int64(len(self.cache_keys) - 1)
            # slots may repeat: each gets the key and the answer of the same, last, entry
            self.cache_keys[place] = fresh
            mine = self.cache_keys[place] == fresh
            self.cache_said[place[mine]] = answer[mine]
        return said

    def _edges(self, codes: np.ndarray, code_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of every piece in ``codes`` (0 ends a part); ``code_of`` maps code points."""
        bits = max(1, (int(code_of.max()) + 1).bit_length())
        per = 63 // bits
        longest = self.t.spelling.shape[1]
        padded = np.concatenate((codes, np.zeros(per * (-(-longest // per)) + per, dtype=np.int64)))
        keys = []
        for base in range(0, longest, per):
            k = np.zeros(len(codes), dtype=np.int64)
            for j in range(per):
                k = (k << bits) | padded[base + j : base + j + len(codes)]
            keys.append(k)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        letters = np.where(self.t.spelling < len(code_of), code_of[np.minimum(self.t.spelling, len(code_of) - 1)], 0)
        lengths = self.t.length[self.t.usable].astype(np.int64)
        there = (letters > 0).sum(1) == lengths
        wanted, letters, lengths = self.t.usable[there], letters[there], lengths[there]
        if not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low_keys, high_keys = np.zeros((len(keys), len(wanted)), np.int64), np.zeros((len(keys), len(wanted)), np.int64)
        full = (1 << bits) - 1
        for j in range(len(keys) * per):
            inside = j < lengths
            letter = letters[:, j] if j < longest else np.zeros(len(wanted), np.int64)
            low_keys[j // per] = (low_keys[j // per] << bits) | np.where(inside, letter, 0)
            high_keys[j // per] = (high_keys[j // per] << bits) | np.where(inside, letter, full)
        low, high = np.searchsorted(keys[0], low_keys[0]), np.searchsorted(keys[0], high_keys[0], side="right")
        for b in range(1, len(keys)):
            deeper = np.flatnonzero((lengths > b * per) & (low < high))
            low[deeper] = _bisect(keys[b], low[deeper], high[deeper], low_keys[b, deeper], False)
            high[deeper] = _bisect(keys[b], low[deeper], high[deeper], high_keys[b, deeper], True)
        n = np.maximum(high - low, 0)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return suffixes[np.repeat(low, n) + offset], np.repeat(wanted, n)

    def _codes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points as small numbers, 0 for those without piece, and the table of these numbers."""
        points = np.unique(raw)
        code_of = np.zeros(int(points[-1]) + 1, dtype=np.int64)
        spelled = [p for p in points.tolist() if chr(p) in self.t.single]
        code_of[spelled] = np.arange(1, len(spelled) + 1)
        return code_of[raw], code_of

    def _learn_long(self, part: str, window: int = 1 << 16) -> None:
        """Ids of one long part. Edges are found a window at a time and relaxed in the order of their starts, one by one; what
        may follow what is asked beforehand for all pieces that meet anywhere in the window."""
        raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        n, longest, size = len(raw), self.t.spelling.shape[1], self.t.size
        last = [-1] * (n + 1)
        before_at, before = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ends and pieces of edges that reach into the window
        for lo in range(0, n, window):
            codes, code_of = self._codes(np.append(raw[lo : lo + window + longest], 0))
            codes[-1] = 0
            starts, pieces = self._edges(codes, code_of)
            starts, pieces = starts[starts < window] + lo, pieces[starts < window]
            lone = np.flatnonzero(codes[: min(window, n - lo)] == 0) + lo
            starts, pieces = np.concatenate((starts, lone)), np.concatenate((pieces, np.full(len(lone), -1)))
            order = np.argsort(starts, kind="stable")
            starts, pieces = starts[order], pieces[order]
            ends = starts + np.where(pieces >= 0, self.t.length[pieces], 1)
            before_at, before = np.concatenate((before_at, ends)), np.concatenate((before, pieces))
            order = np.argsort(before_at, kind="stable")
            before_at, before = before_at[order], before[order]
            first, end = np.searchsorted(before_at, starts), np.searchsorted(before_at, starts, side="right")
            many = end - first
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            left, right = before[at], np.repeat(pieces, many)
            keys = np.unique((left * size + right)[(left >= 0) & (right >= 0)])
            good = set(keys[self.may_follow(keys // size, keys % size)].tolist())
            for s, p, e in zip(starts.tolist(), pieces.tolist(), ends.tolist(), strict=True):
                if p < 0 or (b := last[s]) < 0 or b * size + p in good:
                    last[e] = p
            keep = before_at > lo + window - 1
            before_at, before = before_at[keep], before[keep]
        ids: list[int] = []
        while n:
            p = last[n]
            if p >= 0:
                ids.append(p)
                n -= int(self.t.length[p])
            else:
                n -= 1
                ids += [self.t.byte_id[b] for b in reversed(chr(int(raw[n])).encode("utf-8", "surrogatepass"))]
        self._keep(part, np.array(ids[::-1], dtype="<i4").tobytes())

    def _learn(self, parts: list[str]) -> None:
        """Ids of parts not met so far, all at once."""
        text = "\0".join(parts) + "\0"
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        codes, code_of = self._codes(raw)
        unknown = codes == 0
        unknown[begin + sizes] = False
        starts, pieces = self._edges(codes, code_of)
        lone = np.flatnonzero(unknown)
        starts, pieces = np.concatenate((starts, lone)), np.concatenate((pieces, np.full(len(lone), -1)))
        lengths = np.where(pieces >= 0, self.t.length[pieces], 1)
        part_of = np.repeat(np.arange(len(parts)), sizes + 1)
        end_at = starts - begin[part_of[starts]] + lengths
        order = np.argsort(end_at.astype(np.uint32), kind="stable")
        starts, pieces, lengths, end_at = starts[order], pieces[order], lengths[order], end_at[order]
        # last[x]: the piece that ends before position x on the best path from its part's begin
        last = np.full(len(codes) + 1, -1, dtype=np.int64)
        is_begin = np.zeros(len(codes) + 1, dtype=bool)
        is_begin[begin] = True
        cuts = np.searchsorted(end_at, np.arange(1, int(sizes.max(initial=0)) + 2))
        for k in range(len(cuts) - 1):
            lo, hi = cuts[k], cuts[k + 1]
            if lo == hi:
                continue
            s, p = starts[lo:hi], pieces[lo:hi]
            before = np.where(is_begin[s], -1, last[s])
            ok = self.may_follow(before, p)
            last[s[ok] + lengths[lo:hi][ok]] = p[ok]
        at, live, out = (begin + sizes).copy(), np.arange(len(parts)), []
        while len(live := live[at[live] > begin[live]]):
            p = last[at[live]]
            step = np.where(p >= 0, self.t.length[p], 1)
            at[live] -= step
            out.append((live, p, at[live]))
        if not out:
            return
        of, ids, where = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((where, of))
        of, ids, where = of[order], ids[order].astype("<i4"), where[order]
        edge = np.searchsorted(of, np.arange(len(parts) + 1))
        odd = set(of[ids < 0].tolist())
        flat = ids.tobytes()
        for k, part in enumerate(parts):
            lo, hi = int(edge[k]), int(edge[k + 1])
            if k in odd:
                own: list[int] = []
                for i, x in zip(ids[lo:hi].tolist(), where[lo:hi].tolist(), strict=True):
                    own += [i] if i >= 0 else [self.t.byte_id[b] for b in chr(int(raw[x])).encode("utf-8", "surrogatepass")]
                self._keep(part, np.array(own, dtype="<i4").tobytes())
            else:
                self._keep(part, flat[4 * lo : 4 * hi])

    def _run(self, n: int) -> bytes:
        """Space marks alone: their merges all have one score, so the longest piece is taken from the left each time."""
        out = []
        while n:
            k, piece = max(r for r in self.t.runs if r[0] <= n)
            out.append(piece)
            n -= k
        return np.array(out, dtype="<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        marked = [(MARK if self.t.dummy_prefix else "") + t.replace(" ", MARK) if t else "" for t in texts]
        split = [_PARTS.findall(t) for t in marked]
        if self.held > self.most:
            self.forget()
        fresh = set().union(*split).difference(self.known)
        if fresh:
            marks = {p for p in fresh if p[0] == MARK and not p.strip(MARK)}
            for p in marks:
                self._keep(p, self._run(len(p)))
            for p in (long := {p for p in fresh - marks if len(p) > LONG}):
                self._learn_long(p)
            if rest := list(fresh - marks - long):
                # some hundred thousand characters at a time keep the arrays of edges small
                size = np.cumsum([len(p) for p in rest]) // self.lot
                for lot in np.split(np.array(rest, dtype=object), np.flatnonzero(np.diff(size)) + 1):
                    self._learn(lot.tolist())
        out = []
        for text, parts in zip(marked, split, strict=True):
            ids = [self.known[p] for p in parts]
            for k in range(len(parts) - 1) if MARK + MARK in text else ():
                p = parts[k]
                if p[0] == MARK and not p.strip(MARK) and parts[k + 1][0] == MARK and ids[k + 1][:4] == self.lone:
                    # the mark before the word stayed alone, so it belongs to the run
                    ids[k], ids[k + 1] = self._run(len(p) + 1), ids[k + 1][4:]
            out.append(b"".join(ids))
        return out


class Decoder:
    def __init__(self, model: PieceModel):
        self.dummy_prefix = model.dummy_prefix
        self.as_bytes = [self._spelt(kind, piece) for kind, piece in zip(model.kinds, model.pieces, strict=True)]

    @staticmethod
    def _spelt(kind: int, piece: str) -> bytes:
        if kind == 6:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else piece.replace(MARK, " ").encode("utf-8", "surrogatepass")

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.as_bytes.__getitem__, ids.tolist()))
        if self.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        try:
            return out.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace")


def _bisect(keys: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Where each wanted key belongs within its own range."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = keys[np.minimum(mid, len(keys) - 1)]
        below = open_ & ((at <= wanted) if right else (at < wanted))
        low = np.where(below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    return low


def encode_texts(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", step: int = 4 << 20, most_bytes: int = 96 << 20, lot: int = 250_000) -> DataFrame:
    """Id and ids (array<int>). Fewer characters of texts at a ``step``, fewer ``most_bytes`` of parts kept and smaller
    ``lot``s of characters take less memory and more time; the ids are the same."""
    shared = share(docs.sparkSession, Tables(model))  # one vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.collect()  # the caches of earlier tasks of this worker
        codec = Codec(shared(), most_bytes, lot)
        for b in batches:
            ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in b["text"]]) // step
            for rows in np.split(np.arange(len(b)), np.flatnonzero(np.diff(ends)) + 1):
                part = b.iloc[rows]
                found = codec.encode([t if isinstance(t, str) else None for t in part["text"]])
                yield pd.DataFrame({"id": part["id"].to_numpy(), "ids": [np.frombuffer(x, "<i4") for x in found]})

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, model: PieceModel, id_col: str = "doc_id") -> DataFrame:
    """Id, n_tokens, ids_sha256 (of little-endian 32-bit ids), and the decoded text with its digest."""
    shared = share(encoded.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gc.collect()
        decoder = Decoder(shared())
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                ids = [np.asarray(x, dtype="<i4") for x in part["ids"]]
                texts = [decoder.decode(x) for x in ids]
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "n_tokens": [len(x) for x in ids],
                        "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                        "decoded": texts,
                        "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
                    }
                )

    rows = encoded.select(encoded[id_col].alias("id"), "ids")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = load_model(default_model_path(spark))
    docs = table(spark, sf_dir, "documents")
    found = decode_ids(encode_texts(docs, model), model)
    return found.selectExpr("doc_id", "n_tokens", "ids_sha256", "CAST(length(decoded) AS LONG) AS n_chars", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the token ids of each document's whole text. Executors are full of other stages' memory here."""
    encoded = encode_texts(docs, load_model(default_model_path(spark)), step=1 << 19, most_bytes=24 << 20, lot=80_000)
    return encoded.selectExpr("doc_id", "CAST(size(ids) AS LONG) AS n_tokens", "ids")
