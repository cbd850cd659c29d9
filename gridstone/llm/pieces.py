"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text gets the usual leading space, spaces become U+2581, and it falls into chunks at
places that no piece of the vocabulary crosses. Over the lattice of a chunk's pieces a
path has the product of its pieces' weights, 1 / (2 + rank) ** alpha. Sums of path
weights are filtered forward; the path is drawn backward from them, by a uniform
number a step that comes from the seed, the row's key, the chunk's place and the place
in the chunk. Equal keys and texts give equal pieces, on any partitioning. With alpha
None the best path is taken instead.

A worker takes some MB of text at a time: its distinct chunks' lattices are built and
filtered together, and all occurrences drawn together, in NumPy. Chunks beyond LONG
characters go one by one and keep sums only, a number and an exponent a character, no
edges; sums, order of edges and numbers are the same, so that LONG decides nothing but
the way.

The model is read by the driver and sent to the workers, which need no file.

Decoding joins the pieces' bytes and gives the text back exactly: characters outside
the vocabulary and U+2581 itself are spelt in byte pieces.

Defined cases: a null text gives null pieces and decodes to null; an empty text gives
no pieces; repeated rows (equal keys) give equal pieces; a null key counts as 0; an
empty table gives an empty result; other columns are left alone, but for pieces and
lossless, which are replaced.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 32
SLICE = 400_000
_K = np.uint64(0x9E3779B97F4A7C15)
_M = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M
    return x ^ (x >> 31)


def _splitmix_array(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(state: int, place: int) -> float:
    """The number of a step that ends at a place of a chunk, in [0, 1)."""
    return (_splitmix(state ^ (place * 0xA0761D6478BD642F & _M)) >> 11) * 2.0**-53


def _uniforms(state: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (_splitmix_array(state ^ (place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Codec:
    """The vocabulary of a model with what a worker has learnt of chunks."""

    def __init__(self, model: bytes, alpha: float | None = 1.0, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.greedy, self.seed = alpha is None, seed
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.piece, self.starts = {}, set()
        self.raw = [b""] * size
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.raw[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                score = sp.get_score(i)
                self.piece[name] = (i, (2.0 + (-score if score > -1e8 else size)) ** -(1.0 if alpha is None else alpha))
                self.raw[i] = name.replace(SPACE, " ").encode()
                self.starts.update(name[:k] for k in range(1, len(name) + 1))
        cut = re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}*[^{SPACE}\w]+|{SPACE}*[\d_]+|{SPACE}+")
        if not all(cut.fullmatch(p) for p in self.piece):  # some piece crosses: fall back to cuts before spaces only
            cut = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.chunks, self.size = cut.findall, size
        # prefixes of pieces by 64-bit hash, in a table with linear probing
        prefixes = sorted(self.starts)
        self.deepest = max(map(len, prefixes))
        self.code = np.zeros(len(prefixes) + 1, np.uint64)
        self.own = np.full(len(prefixes) + 1, -1, np.int32)
        self.weight = np.zeros(size + 1)
        self.table = np.full((1 << 20) + 64, -1, np.int32)
        with np.errstate(over="ignore"):
            for k, name in enumerate(prefixes):
                h = np.zeros(1, np.uint64)
                for c in name:
                    h = self._step(h, np.array([ord(c)], np.uint32))
                self.code[k] = h[0]
                at = int(h[0] >> np.uint64(44))
                while self.table[at] >= 0:
                    at += 1
                self.table[at] = k
                if name in self.piece:
                    self.own[k], self.weight[self.piece[name][0]] = self.piece[name]

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c.astype(np.uint64)) * _K + np.uint64(1)
        return h ^ (h >> np.uint64(29))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of the prefix with each hash, or -1."""
        at = (h >> np.uint64(44)).astype(np.int64)
        e = self.table[at]
        while True:
            bad = np.flatnonzero((e >= 0) & (self.code[e] != h))
            if not len(bad):
                return e
            at[bad] += 1
            e[bad] = self.table[at[bad]]

    def _spelt(self, c: str) -> list[int]:
        """A character without a piece, in bytes."""
        return [self.byte[b] for b in (c.encode("utf-8", "surrogatepass"))]

    def draw(self, w: str, state: int) -> list[int]:
        """A path of one chunk of any length. state: the chunk's number."""
        if w[0] == "\x00":  # see _hard
            return self._spelt(w[-1])
        n, deepest, get = len(w), self.deepest, self.piece.get
        reach = self._reach(w)  # the longest prefix of a piece that begins at each place

        def edges(j):
            """Edges (start, ids, weight) to place j by rising length."""
            for i in range(j - 1, max(j - deepest, 0) - 1, -1):
                if reach[i] >= j - i:
                    p = get(w[i:j])
                    if p is not None:
                        yield i, (p[0],), p[1]
            if w[j - 1] not in self.piece:
                yield j - 1, None, 1e-6  # last, as in _lattices

        total, scale = array("d", [1.0]), array("i", [0])  # of a place: total * 2 ** -scale
        for j in range(1, n + 1):
            s, now = 0.0, scale[j - 1]
            for i, _, x in edges(j):
                x *= total[i] * 2.0 ** (now - scale[i])
                s = max(s, x) if self.greedy else s + x
            if s < 2.0**-300:
                s, now = s * 2.0**300, now + 300
            total.append(s)
            scale.append(now)
        j, parts = n, []
        while j:
            found, s = [], 0.0
            for i, ids, x in edges(j):
                x *= total[i] * 2.0 ** (scale[j] - scale[i])
                s = max(s, x) if self.greedy else s + x
                found.append((i, ids, x, s))
            t = _uniform(state, j) * s
            if self.greedy:
                i, ids, _, _ = max(found, key=lambda e: e[2])
            else:
                i, ids, _, _ = next((e for e in found if e[3] > t), found[-1])
            parts.append(self._spelt(w[i]) if ids is None else ids)
            j = i
        return [x for ids in reversed(parts) for x in ids]

    def _reach(self, w: str) -> bytes:
        starts, out = self.starts, bytearray(len(w))
        for i in range(len(w)):
            k = 0
            while i + k < len(w) and w[i : i + k + 1] in starts:
                k += 1
            out[i] = min(k, 255)
        return bytes(out)

    def _lattices(self, chunks: list[str], lens: np.ndarray) -> dict:
        """Lattices of short chunks: nodes are the places between characters; each has its edges by rising length of the piece."""
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        i32, lens = np.int32, lens.astype(np.int32)  # narrow numbers: this is bound by memory
        begin = (np.cumsum(lens) - lens).astype(i32)
        chunk = np.repeat(np.arange(len(lens), dtype=i32), lens)
        pos = np.arange(len(chars), dtype=i32) - begin[chunk]
        left = lens[chunk] - pos
        chunk += np.arange(len(chars), dtype=i32)  # from here: the node before each character
        nodes = len(chars) + len(lens)
        at, h, found = np.arange(len(chars), dtype=i32), np.zeros(len(chars), np.uint64), []
        odd = None
        for n in range(1, self.deepest + 1):
            h = self._step(h, chars[at + n - 1])
            e = self._find(h)
            live = e >= 0
            own = self.own[e]
            is_piece = live & (own >= 0)
            if n == 1:
                odd = np.flatnonzero(~is_piece)
            found.append((chunk[at[is_piece]], own[is_piece]))
            live &= left[at] > n
            at, h = at[live], h[live]
            if not len(at):
                break
        spelt, which = np.unique(chars[odd], return_inverse=True)
        found.append((chunk[odd], (self.size + 1 + which).astype(i32)))
        steps = [*range(1, len(found)), 1]
        degree = np.zeros(nodes, i32)
        for n, (i, _) in zip(steps, found):
            degree[i + n] += 1  # one edge of a length and end at most
        first = (np.cumsum(degree) - degree).astype(i32)
        filled = first.copy()
        total = int(degree.sum())
        source, seq, weight = np.zeros(total, i32), np.zeros(total, i32), np.zeros(total)
        table = np.concatenate([self.weight, np.full(len(spelt), 1e-6)])
        for n, (i, ids) in zip(steps, found):
            slot = filled[i + n]
            filled[i + n] = slot + 1
            source[slot], seq[slot], weight[slot] = i, ids, table[ids]
        mass, upto, best = np.zeros(nodes), np.zeros(total), np.zeros(nodes, np.int64)
        mass[begin + np.arange(len(lens), dtype=i32)] = 1.0
        place = np.zeros(nodes, np.uint8)
        place[chunk + 1] = pos + 1
        order = np.argsort(place, kind="stable").astype(i32)
        bounds = np.searchsorted(place[order], np.arange(1, int(place.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            node = order[lo:hi]
            slot, more = first[node], degree[node]
            sums, k = np.zeros(len(node)), 0
            while len(node):
                x = mass[source[slot]] * weight[slot]
                if self.greedy:
                    better = x > sums
                    best[node[better]] = slot[better]
                    sums = np.maximum(sums, x)
                else:
                    sums = sums + x
                upto[slot] = sums
                k += 1
                done = more <= k
                mass[node[done]] = sums[done]
                node, slot, more, sums = node[~done], slot[~done] + 1, more[~done], sums[~done]
        return {"begin": begin, "lens": lens, "first": first, "degree": degree, "source": source, "seq": seq, "mass": mass, "upto": upto, "best": best, "spelt": spelt}

    def encode(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts after another, and the number of ids of each text."""
        words, count = [], []
        for t in texts:
            own = [] if not t else self._hard(t) if SPACE in t or "\x00" in t else self.chunks(SPACE + t.replace(" ", SPACE))
            words += own
            count.append(len(own))
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        with np.errstate(over="ignore"):
            return self._encode(words, np.array(count, np.int64), keys)

    def _encode(self, words: list[str], count: np.ndarray, keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
        start = _splitmix_array(np.array(keys, np.int64).view(np.uint64) ^ np.uint64(self.seed & _M))
        state = _splitmix_array(start[row] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for w in words], np.int32)
        chunks = list(number)
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        short = lens <= LONG
        short[[k for k, w in enumerate(chunks) if w[0] == "\x00"]] = False
        occ = np.flatnonzero(short[which])
        lat = self._lattices([w for w, ok in zip(chunks, short) if ok], lens[short])
        own = (np.cumsum(short, dtype=np.int32) - 1)[which[occ]]
        base = lat["begin"][own] + own
        node = base + lat["lens"][own]
        who, taken, state_of = np.arange(len(occ), dtype=np.int32), [], state[occ]
        first, degree, source, upto, mass = (lat[k] for k in ("first", "degree", "source", "upto", "mass"))
        while len(who):
            e = first[node]
            if self.greedy:
                e = lat["best"][node]
            else:
                t, last = _uniforms(state_of[who], node - base[who]) * mass[node], e + degree[node] - 1
                ahead = np.flatnonzero((upto[e] <= t) & (e < last))
                while len(ahead):
                    e[ahead] += 1
                    k = e[ahead]
                    ahead = ahead[(upto[k] <= t[ahead]) & (k < last[ahead])]
            taken.append((who, lat["seq"][e]))
            node = source[e]
            go = node > base[who]
            who, node = who[go], node[go]
        steps = np.bincount(np.concatenate([w for w, _ in taken]) if taken else np.zeros(0, np.int32), minlength=len(occ))
        long = np.flatnonzero(~short[which])
        drawn = [self.draw(words[i], s) for i, s in zip(long.tolist(), state[long].tolist())]
        width = np.zeros(len(words), np.int64)
        width[occ], width[long] = steps, [len(d) for d in drawn]
        begin = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int32)
        back = begin[occ] + steps - 1
        for k, (w, seq) in enumerate(taken):
            out[back[w] - k] = seq
        for i, d in zip(long, drawn):
            out[begin[i] : begin[i] + len(d)] = d
        total = np.bincount(row, weights=width, minlength=len(count)).astype(np.int64)
        if len(lat["spelt"]):  # characters in bytes
            bytes_of = [self._spelt(chr(c)) for c in lat["spelt"]]
            size = np.ones(len(out), np.int64)
            odd = np.flatnonzero(out > self.size)
            size[odd] = np.array([len(b) for b in bytes_of])[out[odd] - self.size - 1]
            to = np.cumsum(size) - size
            wide = np.repeat(out, size)
            for i in odd.tolist():
                b = bytes_of[out[i] - self.size - 1]
                wide[to[i] : to[i] + len(b)] = b
            ends = np.concatenate([[0], np.cumsum(total)])
            total = np.diff(np.concatenate([to, [len(wide)]])[ends])
            out = wide
        return out, total

    def _hard(self, t: str) -> list[str]:
        """Chunks of a text that holds U+2581 or NUL itself: each of these is a chunk of its own, spelt in bytes."""
        out = []
        for k, part in enumerate(re.split(f"([{SPACE}\x00])", t)):
            if k % 2:
                out.append("\x00" if part == "\x00" else "\x00" + part)
            elif part or k == 0:
                own = part.replace(" ", SPACE)
                out += self.chunks(SPACE + own) if k == 0 else self.chunks(own)
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


@functools.lru_cache(maxsize=2)
def codec(model: bytes, alpha: float | None, seed: int) -> Codec:
    return Codec(model, alpha, seed)


def _sent(docs: DataFrame, model: str):
    """The model's file (some MB at most) as a broadcast."""
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL, alpha: float | None = 1.0, seed: int = 0, key: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """docs with pieces array<int> and lossless boolean (whether the pieces decode to the text; null for a null text); without text on request."""
    others = [c for c in docs.columns if c not in ("pieces", "lossless")]
    used = docs.select(F.col(key).cast("bigint").alias("__key"), F.col("text").alias("__text"), F.struct(*[c for c in others if c != "text"]).alias("__row"))
    held = _sent(docs, model)

    def run(batches):
        c = codec(held.value, alpha, seed)
        for batch in batches:
            keys = [k or 0 for k in batch.column(0).to_pylist()]
            texts = batch.column(1).to_pylist()
            begin, total = 0, 0
            for k, t in enumerate(texts):
                total += len(t or "")
                if total >= SLICE or k == len(texts) - 1:
                    part = texts[begin : k + 1]
                    ids, n = c.encode([t or "" for t in part], keys[begin : k + 1])
                    at = np.concatenate([[0], np.cumsum(n)])
                    same = [None if t is None else (c.decode(ids[at[j] : at[j + 1]].tolist()) == t) for j, t in enumerate(part)]
                    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in part]))
                    out = [batch.column(2).slice(begin, len(part)), lists, pa.array(same, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(out + [batch.column(1).slice(begin, len(part))] * keep_text, ["__row", "pieces", "lossless"] + ["text"] * keep_text)
                    begin, total = k + 1, 0

    row = used.schema["__row"].dataType.simpleString()
    made = used.mapInArrow(run, f"__row {row}, pieces array<int>, lossless boolean" + ", text string" * keep_text)
    kept = [c for c in others if c != "text" or keep_text]
    return made.select("__row.*", *["text"] * keep_text, "pieces", "lossless").select(*kept, "pieces", "lossless")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with text, decoded from pieces."""
    held = _sent(encoded, model)

    def run(batches):
        c = codec(held.value, 1.0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else c.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["__row", "text"])

    used = encoded.select(F.struct(*[c for c in encoded.columns if c != "text"]).alias("__row"), F.col("pieces").alias("__pieces"))
    return used.mapInArrow(run, f"__row {used.schema['__row'].dataType.simpleString()}, text string").select("__row.*", "text")


def pieces_report(docs: DataFrame, model: str = MODEL, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra columns, n_pieces, pieces, lossless of every document."""
    df = encode(docs.select("doc_id", *extra, "text"), model, keep_text=False)
    return df.select("doc_id", *extra, F.when(F.col("pieces").isNotNull(), F.size("pieces")).cast("bigint").alias("n_pieces"), "pieces", "lossless")
