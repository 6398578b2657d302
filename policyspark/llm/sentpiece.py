"""SentencePiece segmentations sampled without replacement, and their decoding.

The lattice of a text holds every way to cut it into pieces of a public vocabulary (a character
that no piece has falls back to its bytes). A piece of rank r weighs as (r + 10) ** -alpha, since
the vocabulary file has ranks instead of probabilities. Gumbel top-k: every segmentation has its
log-probability plus Gumbel noise; the k best are a sample without replacement. They are found by
A-star search, top down: a set of segmentations (a prefix of pieces and the next pieces still
allowed) has the greatest perturbed value of its members as its exact bound. The best set is
popped and followed to its best member; what is left at each piece passed becomes a set of its
own with a truncated Gumbel as its bound. The search ends after k members; the next best bound is
the threshold from which a member's inclusion probability follows.

Pieces never cross a space's left side or a line break, so the lattice of a text is a chain of
the lattices of its units. Those are built once for each distinct unit of a block of texts, and
all units of a block walk theirs in step. Noise is a hash of the row key and the place, so a
row's samples depend on nothing but the row.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from policyspark.llm.common import give_back, typed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNITS = re.compile(r"\n| *[^ \n]+| +")
SPACE, BLOCK = "▁", 300_000  # characters of a block of texts


class Vocabulary:
    """A trie of the pieces as a double array over character classes."""

    def __init__(self, pieces: tuple[str, ...], alpha: float = 1.0):
        self.pieces = pieces
        special = {i for i, p in enumerate(pieces) if p in ("<unk>", "<s>", "</s>")}
        self.bytes = np.zeros(256, np.int64)
        self.raw: list[bytes] = [b""] * len(pieces)
        weight = np.zeros(len(pieces))
        usable = {}
        first = next((i for i, p in enumerate(pieces) if i not in special and not re.fullmatch("<0x[0-9A-F]{2}>", p)), 0)
        for i, p in enumerate(pieces):
            if m := re.fullmatch("<0x([0-9A-F]{2})>", p):
                self.bytes[int(m[1], 16)] = i
                self.raw[i] = bytes([int(m[1], 16)])
                weight[i] = -alpha * np.log(len(pieces) + 10)
            elif i not in special:
                usable[p] = i
                self.raw[i] = p.replace(SPACE, " ").encode()
                weight[i] = -alpha * np.log(i - first + 10)
        self.weight, self.byte_weight = weight, float(-alpha * np.log(len(pieces) + 10))
        letters = sorted({c for p in usable for c in p})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, c in enumerate(letters, 1):
            self.classes[ord(c)] = k
        self.classes[ord(" ")], self.classes[ord(SPACE)] = self.classes[ord(SPACE)], 0
        self.longest = max(map(len, usable), default=1)
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for p, i in usable.items():
            at = 0
            for c in p:
                k = letters_index(self.classes, c)
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][k]
            ends[at] = i
        size = 2 * len(children) + len(letters) + 2
        base, check, piece = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        used, queue, free = bytearray(size), [(0, 0)], 1
        used[0] = 1
        for node, slot in queue:
            keys = sorted(children[node])
            if not keys:
                continue
            b = max(1, free - keys[0])
            tried = 0
            while any(used[b + k] if b + k < size else 0 for k in keys):
                b, tried = b + 1, tried + 1
            if tried > 100:
                free = max(free, b - 50)  # holes before here are few and far between
            if b + keys[-1] >= size:
                grow = b + keys[-1] + len(letters) + 1 - size
                base, check, piece = (np.concatenate([a, np.full(grow, v)]) for a, v in ((base, 0), (check, -1), (piece, -1)))
                used.extend(bytes(grow))
                size += grow
            base[slot] = b
            for k in keys:
                used[b + k] = 1
                check[b + k], piece[b + k] = slot, ends[children[node][k]]
                queue.append((children[node][k], b + k))
            while free < size and used[free]:
                free += 1
        pad = len(letters) + 1
        self.base, self.check, self.piece = (np.concatenate([a, np.full(pad, v)]) for a, v in ((base, 0), (check, -1), (piece, -1)))

        self.joined = np.frombuffer(b"".join(self.raw), np.uint8)
        self.sizes = np.fromiter(map(len, self.raw), np.int64, len(self.raw))
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def spelt(self, ids: list[np.ndarray]) -> list[bytes]:
        """What each of several sequences of pieces spells, the leading space that encoding adds included."""
        flat = np.concatenate(ids)
        sizes = self.sizes.take(flat)
        ends = np.cumsum(sizes)
        at = np.repeat(self.offsets.take(flat) - (ends - sizes), sizes)
        at += np.arange(len(at))
        text, cuts = self.joined.take(at).tobytes(), np.concatenate(([0], ends))[np.cumsum([0, *map(len, ids)])].tolist()
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        """The text: pieces joined, the leading space that encoding adds taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def letters_index(classes: np.ndarray, c: str) -> int:
    return int(classes[ord(" " if c == SPACE else c)])


@lru_cache(maxsize=4)
def vocabulary(pieces: tuple[str, ...], alpha: float) -> Vocabulary:
    return Vocabulary(pieces, alpha)


def load(model: str = MODEL) -> tuple[str, ...]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return tuple(sp.id_to_piece(i) for i in range(sp.get_piece_size()))


def uniform(key: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """In (0, 1), by splitmix64 of a key and two counters."""
    with np.errstate(over="ignore"):
        x = key + a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Numbers(dict[str, int]):
    """Numbers words in order of their first lookup."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Lattices:
    """The lattices of distinct units: a slot for each character and one for each unit's end."""

    def __init__(self, v: Vocabulary, words: list[str]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        size = int(self.ends[-1]) + 1 if len(words) else 0
        codes = np.zeros(size, np.int64)
        inside = np.ones(size, bool)
        inside[self.ends] = False
        codes[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        ahead = np.repeat(self.ends, lengths + 1) - np.arange(size)  # characters up to the unit's end
        classes, wide = v.classes.take(codes), -(-v.longest // 8) * 8
        self.ids = np.full((size, wide), -1, np.int32)
        logs = np.full((size, wide), -np.inf, np.float32)
        at = np.flatnonzero(inside)
        state = np.zeros(len(at), np.int64)
        for n in range(wide):
            live = ahead[at] > n
            at, state = at[live], state[live]
            letter = classes.take(at + n)
            to = v.base.take(state) + letter
            live = (v.check.take(to) == state) & (letter > 0)
            at, state = at[live], to[live]
            found = v.piece.take(state)
            some = found >= 0
            where, found = at[some] * wide + n, found[some]
            self.ids.reshape(-1)[where] = found
            logs.reshape(-1)[where] = v.weight.take(found)
            if not len(at):
                break
        lost = np.flatnonzero(inside & (self.ids[:, 0] < 0))
        chars = codes[lost]
        bytes_of = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        logs[lost, 0] = bytes_of * v.byte_weight
        self.ids[lost, 0] = -2 - chars  # falls back to bytes
        self.beta = np.zeros(size + wide)
        order = np.argsort(ahead.astype(np.uint16) if ahead.max(initial=0) < 65_536 else ahead, kind="stable")  # short numbers are sorted by radix
        cuts = np.searchsorted(ahead[order], np.arange(1, int(ahead.max(initial=0)) + 2))
        self.cdf = np.ones((size, wide), np.float32)
        for d in range(len(cuts) - 1):
            p = order[cuts[d] : cuts[d + 1]]
            w = min(d + 1, wide)
            total = logs.take(p, axis=0)[:, :w].T + self.beta.take(p + np.arange(1, w + 1)[:, None])
            top = total.max(axis=0)
            mass = np.exp((total - top).astype(np.float32))
            for c in range(1, w):
                mass[c] += mass[c - 1]
            self.beta[p] = top + np.log(mass[-1])
            self.cdf[p, :w] = (mass / mass[-1]).T
        self.logs = logs

    def log_share(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probability of going on by n + 1 characters at slot p."""
        return np.minimum(0.0, self.logs.reshape(-1).take(p * self.logs.shape[1] + n) + self.beta.take(p + n + 1) - self.beta.take(p))

    def walk(self, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, place: np.ndarray, try_no: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled paths from each start to its end: pieces of each path, and slots, steps and logs of all pieces in order."""
        counts = np.zeros(len(starts), np.int64)
        live, p, seen, step = np.flatnonzero(starts < ends), starts[starts < ends], [], 0
        while len(live):
            u = uniform(key[live], (place[live] << 32) + step, try_no)
            below = np.bitwise_count((self.cdf.take(p, axis=0) < u[:, None].astype(np.float32)).view(np.uint64))  # eight comparisons a word
            n = below[:, 0].astype(np.int64)
            for c in range(1, below.shape[1]):
                n += below[:, c]
            n = np.minimum(n, self.cdf.shape[1] - 1)
            bad = ~np.isfinite(self.logs.reshape(-1).take(p * self.logs.shape[1] + n))
            if bad.any():  # a rounded share: the nearest piece that exists
                n[bad] = np.isfinite(self.logs[p[bad]]).argmax(axis=1)
            seen.append((live, p, n))
            counts[live] += 1
            p = p + n + 1
            on = p < ends[live]
            live, p, step = live[on], p[on], step + 1
        first = np.cumsum(counts) - counts
        slots, steps = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
        for i, (who, p, n) in enumerate(seen):
            slots[first[who] + i], steps[first[who] + i] = p, n
        return counts, slots, steps, self.log_share(slots, steps)


def bound(limit: float | np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Greatest perturbed value of sets with those log-probabilities, given that it is below limit."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-limit, np.log(-np.log(u)) - log_mass)


def rest(log_share: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(-np.expm1(log_share), 0))


class Path:
    """A segmentation: units, slots and steps of its pieces, log-probability before each."""

    __slots__ = ("unit", "slots", "steps", "logs", "value", "barred")

    def __init__(self, unit: np.ndarray, slots: np.ndarray, steps: np.ndarray, logs: np.ndarray, value: float):
        self.unit, self.slots, self.steps, self.logs, self.value = unit, slots, steps, logs, value


def sample(v: Vocabulary, texts: list[str], keys: list[int], k: int) -> list[list[tuple[list[int], float, float]]]:
    """For each text up to k distinct segmentations: (ids, log-probability, inclusion probability), best perturbed value first."""
    index = Numbers()
    units = [np.fromiter(map(index.__getitem__, UNITS.findall(" " + t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    lat = Lattices(v, list(index))
    seeds = uniform(np.array([x & (2**64 - 1) for x in keys], np.uint64), np.arange(1), 99)
    seeds = (seeds * 2.0**53).astype(np.uint64) << np.uint64(10)
    done: list[list[Path]] = [[] for _ in texts]
    heaps: list[list[tuple[float, int, int, tuple[int, ...], Path]]] = [[] for _ in texts]
    # what to follow next: text, first unit, first slot, pieces before, value
    jobs = [(i, 0, None, None, value) for i, value in enumerate((-np.log(-np.log(uniform(seeds, np.zeros(len(texts), np.int64), 7)))).tolist())]
    for try_no in range(1, k + 1):
        starts, ends, key, place, sizes = [], [], [], [], []
        for i, at, slot, _, _ in jobs:
            u = units[i][at:]
            s, e = lat.starts[u], lat.ends[u]
            if slot is not None:
                s = s.copy()
                s[0] = slot
            starts.append(s)
            ends.append(e)
            place.append(np.arange(at, at + len(u)))
            key.append(i)
            sizes.append(len(u))
        if not jobs:
            break
        starts, ends, place = (np.concatenate(x) for x in (starts, ends, place))
        key = np.repeat(seeds[key], sizes)
        counts, slots, steps, logs = lat.walk(starts, ends, key, place, try_no)
        owner = np.repeat(place, counts)
        stops = np.concatenate(([0], np.cumsum(counts)))[np.cumsum(sizes)]
        firsts = np.concatenate(([0], stops[:-1]))
        lengths = stops - firsts
        # the sets left at each new piece: their masses and bounds, for all paths at once
        kept, share, base = np.zeros(len(jobs), np.int64), np.zeros(len(jobs)), np.zeros(len(jobs))
        if again := [(j, *before) for j, (_, _, _, before, _) in enumerate(jobs) if before is not None]:
            shares = lat.log_share(np.array([parent.slots[cut] for _, parent, cut, _ in again]), np.array([barred[-1] for *_, barred in again]))
            for (j, parent, cut, _), one in zip(again, shares.tolist(), strict=True):
                share[j], kept[j], base[j] = one, cut + 1, parent.logs[:cut].sum() + one
        sums = np.cumsum(logs) - logs
        offset = base - (sums[np.minimum(firsts, max(len(sums) - 1, 0))] if len(sums) else 0)
        number = np.arange(len(logs)) - np.repeat(firsts - kept, lengths)
        noise = uniform(np.repeat(seeds[[j[0] for j in jobs]], lengths), number, 2000 + try_no)
        bounds = bound(np.repeat([j[4] for j in jobs], lengths), sums + np.repeat(offset, lengths) + rest(logs), noise)
        for j, ((i, _, _, before, value), a, b) in enumerate(zip(jobs, firsts.tolist(), stops.tolist(), strict=True)):
            new, held = Path(owner[a:b], slots[a:b], steps[a:b], logs[a:b], value), int(kept[j])
            if before is not None:
                parent, cut, barred = before
                new = Path(*(np.concatenate([x[:cut], y, z]) for x, y, z in ((parent.unit, parent.unit[cut : cut + 1], new.unit), (parent.slots, parent.slots[cut : cut + 1], new.slots), (parent.steps, [barred[-1]], new.steps), (parent.logs, [share[j]], new.logs))), value)
                left = 1 - sum(float(np.exp(lat.log_share(parent.slots[cut : cut + 1], np.array([n]))[0])) for n in barred)
                if left > 1e-12 and np.isfinite(lat.logs[parent.slots[cut]]).sum() > len(barred):
                    mass = float(parent.logs[:cut].sum()) + np.log(left)
                    top = float(bound(value, np.array([mass]), uniform(seeds[i : i + 1], np.array([cut]), 1000 + try_no))[0])
                    heapq.heappush(heaps[i], (-top, len(done[i]), cut, barred, parent))
            done[i].append(new)
            if b > a:
                tops = bounds[a:b]
                want = min(len(tops), k - len(done[i]) + 1)
                best = [int(tops.argmax())] if want == 1 else np.argpartition(-tops, want - 1)[:want].tolist()
                for at in best:
                    if np.isfinite(tops[at]):
                        heapq.heappush(heaps[i], (-float(tops[at]), len(done[i]), held + at, (int(new.steps[held + at]),), new))
        jobs = []
        if try_no < k:
            best = [(i, *heapq.heappop(heap)) for i, heap in enumerate(heaps) if heap]
            us = uniform(seeds[[b[0] for b in best]], np.array([b[3] for b in best], np.int64), 3000 + try_no).tolist()
            for (i, top, _, cut, barred, parent), u in zip(best, us, strict=True):
                p = int(parent.slots[cut])
                share = np.exp(np.where(np.isfinite(lat.logs[p]), lat.logs[p] + lat.beta[p + 1 : p + 1 + lat.logs.shape[1]] - lat.beta[p], -np.inf))
                share[list(barred)] = 0
                if share.sum() <= 0:
                    continue
                took = int(min(np.searchsorted(share.cumsum(), u * share.sum()), np.flatnonzero(share)[-1]))
                jobs.append((i, int(parent.unit[cut]), p + took + 1, (parent, cut, (*barred, took)), -top))
    every = [path for paths in done for path in paths]
    ids = lat.ids.reshape(-1).take(np.concatenate([p.slots for p in every]) * lat.ids.shape[1] + np.concatenate([p.steps for p in every])) if every else np.zeros(0, np.int32)
    cuts = np.concatenate(([0], np.cumsum(lengths_of(ids))))[np.cumsum([0, *(len(p.slots) for p in every)])].tolist()
    ids, n, out = spelled(v, ids), 0, []
    for paths, heap in zip(done, heaps, strict=True):
        limit = -heap[0][0] if heap else -np.inf
        rows = []
        for path in paths:
            log = float(path.logs.sum())
            rows.append((ids[cuts[n] : cuts[n + 1]], log, 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(700.0, log - limit))))))
            n += 1
        out.append(rows)
    return out


def lengths_of(ids: np.ndarray) -> np.ndarray:
    """How many pieces each of ids stands for: one, or the bytes of a character that falls back (-2 - code point)."""
    chars = -2 - ids
    return np.where(ids >= 0, 1, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))


def spelled(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """ids with the characters that fall back (-2 - code point) replaced by their bytes' pieces."""
    chars, lengths = -2 - ids, lengths_of(ids)
    out, first = np.repeat(ids, lengths), np.cumsum(lengths) - lengths
    short = (ids < 0) & (lengths == 1)
    out[first[short]] = v.bytes[chars[short]]
    for i in np.flatnonzero(lengths > 1).tolist():
        out[first[i] : first[i] + lengths[i]] = v.bytes[list(chr(chars[i]).encode("utf-8", "surrogatepass"))]
    return out


def key_of(doc_id: object, text: str) -> int:
    if isinstance(doc_id, int):
        return doc_id
    return zlib.crc32((text if doc_id is None else str(doc_id)).encode("utf-8", "surrogatepass"))


def sampled(docs: DataFrame, pieces: tuple[str, ...], k: int = 2, alpha: float = 1.0) -> DataFrame:
    """Up to k rows a document: doc_id, sample (from 1), ids, n_pieces, log_prob, inclusion, round_trip.

    A null or empty text has one segmentation, without pieces. Fewer rows than k: the text has no
    more segmentations. The row key is doc_id, the checksum of an id that is no integer; rows
    without one use their text's checksum. Repeated rows repeat, an empty table gives no rows,
    other columns are not read.
    """
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*shared.value)
        for batch in batches:
            block, size, rows = [], 0, list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for i, (doc, text) in enumerate(rows):
                block.append((doc, text or ""))
                size += len(text or "")
                if size >= BLOCK or i + 1 == len(rows):
                    found = sample(v, [t for _, t in block], [key_of(d, t) for d, t in block], k)
                    flat = [(d, n, *s, (" " + t).encode() if t else b"") for (d, t), samples in zip(block, found, strict=True) for n, s in enumerate(samples, 1)]
                    docs_, n_, ids, logs, inc, given = zip(*flat, strict=True)
                    ok = [told == t for told, t in zip(v.spelt(ids), given, strict=True)]
                    lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.array(np.concatenate(ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(docs_, kind), pa.array(n_, pa.int32()), lists, pa.array(lengths), pa.array(logs, pa.float64()), pa.array(inc, pa.float64()), pa.array(ok, pa.bool_())], ["doc_id", "sample", "ids", "n_pieces", "log_prob", "inclusion", "round_trip"])
                    block, size = [], 0
                    del found, flat, docs_, n_, ids, logs, inc, given, ok, lengths, lists  # before the next block is taken up
            rows = []
        give_back()

    schema = typed(docs, "doc_id", sample=T.IntegerType(), ids=T.ArrayType(T.IntegerType()), n_pieces=T.IntegerType(), log_prob=T.DoubleType(), inclusion=T.DoubleType(), round_trip=T.BooleanType())
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, pieces: tuple[str, ...]) -> DataFrame:
    """rows (doc_id, sample, ids) with the text their pieces spell."""
    shared = rows.sparkSession.sparkContext.broadcast((pieces, 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.decode(x or []) for x in batch.column(2).to_pylist()], pa.string())], ["doc_id", "sample", "text"])

    return rows.select("doc_id", "sample", "ids").mapInArrow(run, typed(rows, "doc_id", sample=T.IntegerType(), text=T.StringType()))
