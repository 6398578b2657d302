"""Two tokenizers' pieces of the same texts, aligned by bytes, with corpus-wide counts of what is aligned.

Places where tokens of both end cut a text into groups. Every distinct group of A ids and B ids is
kept once in a dictionary, and its links (pairs whose bytes overlap) are made once, not at each of
its places. Three passes: texts are encoded in blocks, each with a dictionary of its own groups
and the number of its documents that hold each pair; pairs are summed over the blocks; each
distinct group gets the sums over its links, and these are joined back by the group's key to the
blocks that hold it, where documents multiply them by how often they hold the group.

Neither tokenizer joins anything over a single space between two other characters, so a text is
encoded word by word, each distinct word once. Where a vocabulary doesn't allow that, texts are
encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policyspark.llm.common import checkpoint, known_few, scratch, typed

BYTES_A, PIECES_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLOCK, KNOWN, AT_ONCE = 4_000_000, 200_000, 20_000  # characters of a block; words held encoded; words encoded at once
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"


def load(a: str = BYTES_A, b: str = PIECES_B) -> tuple[str, bytes]:
    """The two vocabulary files, read by the driver: they are a few megabytes."""
    with open(a, encoding="utf-8") as first, open(b, "rb") as second:
        return first.read(), second.read()


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


class Encoders:
    """Both tokenizers, the bytes of their tokens, and the words encoded so far with their groups."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.a, self.b = Tokenizer.from_str(a), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        letters, kind = byte_letters(), json.loads(a)
        self.a_bytes = {i: bytes(letters[c] for c in p) if all(c in letters for c in p) else p.encode() for p, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        level = kind.get("pre_tokenizer") or {}
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.by_word = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not kind.get("normalizer") and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.sizes: list[np.ndarray] = []  # of words: A tokens, B tokens, groups, links, whether the bytes are right
        self.texts: list[str] = []  # a word's groups, written out
        self.of: list[np.ndarray] = []  # the numbers of words' groups, one word after the other
        self.groups: dict[str, int] = {}
        self.names: list[str] = []  # groups by number
        self.pairs: dict[tuple[int, int], int] = {}
        self.linked: list[list[int]] = []  # of a group: its distinct pairs' numbers

    def group(self, key: str) -> int:
        """The number of a group, its links made when it is new."""
        if key not in self.groups:
            self.groups[key] = len(self.names)
            self.names.append(key)
            self.linked.append([self.pairs.setdefault(p, len(self.pairs)) for p in dict.fromkeys(self.links(key))])
        return self.groups[key]

    def split(self, text: str) -> list[str]:
        first, *rest = CUT.split(" " + text) if self.by_word else [" " + text]
        return [first, *(" " + r for r in rest)]

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known, each with the space it begins with, and cuts them into groups."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        for at in range(0, len(new), AT_ONCE):
            self._learn(new[at : at + AT_ONCE])

    def _learn(self, new: list[str]) -> None:
        a_lists = [x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)]
        b_lists = self.b.encode([w[1:] for w in new], num_threads=1)
        (a, a_at), (b, b_at) = _flat(a_lists), _flat(b_lists)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        long = np.fromiter(map(len, raw), np.int64, len(raw))
        right = np.ones(len(new), bool)
        for ids, at, names, sizes in ((a, a_at, self.a_bytes, self.a_sizes), (b, b_at, self.b_bytes, self.b_sizes)):
            right &= np.diff(np.concatenate(([0], np.cumsum(sizes[ids])))[at]) == long
            if not right.all() or b"".join(map(names.__getitem__, ids.tolist())) != b"".join(raw):
                right &= [b"".join(map(names.__getitem__, ids[i:j].tolist())) == x for i, j, x in zip(at[:-1], at[1:], raw, strict=True)]
        n_a, n_b = np.diff(a_at), np.diff(b_at)
        a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
        group_of_a, group_of_b, ends = groups(self.a_sizes[a], self.b_sizes[b])
        of_word = np.bincount(np.searchsorted(np.cumsum(long[right]), ends), minlength=int(right.sum()))
        in_a, in_b = np.bincount(group_of_a, minlength=len(ends)), np.bincount(group_of_b, minlength=len(ends))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        numbers = np.zeros(len(ends), np.int64)
        single = (in_a == 1) & (in_b == 1)
        codes, place = np.unique(a[first_a[single]] << 32 | b[first_b[single]], return_inverse=True)
        numbers[single] = np.array([self.group(f"{c >> 32}|{c & 0xFFFFFFFF}") for c in codes.tolist()], np.int64)[place]
        others = np.flatnonzero(~single)
        spelled = lambda ids, first, n: map(",".join, _cut(list(map(str, ids.tolist())), first[others], n[others]))
        numbers[others] = [self.group(f"{x}|{y}") for x, y in zip(spelled(a, first_a, in_a), spelled(b, first_b, in_b), strict=True)]
        n_groups = np.zeros(len(new), np.int64)
        n_groups[right] = of_word
        written = list(map(self.names.__getitem__, numbers.tolist()))
        self.texts += map(";".join, _cut(written, np.cumsum(n_groups) - n_groups, n_groups))
        self.words |= zip(new, range(len(self.words), len(self.words) + len(new)), strict=True)
        self.of.append(numbers)
        # no two inner ends of a group meet, so its tokens overlap one time less than there are of them
        self.sizes.append(np.stack([n_a, n_b, n_groups, np.where(right, n_a + n_b - n_groups, 0), right], axis=1))

    def links(self, key: str) -> list[tuple[int, int]]:
        """The pairs of a group whose byte ranges overlap, at each of their places."""
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        i = j = 0
        left, right, out = len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]]), []
        while True:
            out.append((a[i], b[j]))
            step = min(left, right)
            left, right = left - step, right - step
            if not left:
                i += 1
                if i == len(a):
                    return out
                left = len(self.a_bytes[a[i]])
            if not right:
                j += 1
                right = len(self.b_bytes[b[j]])


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of each A token and each B token, and where the groups end, for tokens of so many bytes: cut where both end."""
    a, b = np.cumsum(a), np.cumsum(b)
    ends = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(ends, a), np.searchsorted(ends, b), ends


def _cut(values: list[str], first: np.ndarray, sizes: np.ndarray) -> Iterator[list[str]]:
    """Stretches of a list."""
    return (values[i : i + n] for i, n in zip(first.tolist(), sizes.tolist(), strict=True))


@lru_cache(maxsize=1)
def encoders(a: str, b: bytes) -> Encoders:
    return Encoders(a, b)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and where each starts."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=starts[1:])
    return np.fromiter((x for l in lists for x in l), np.int64, int(starts[-1])), starts


def _take(values: np.ndarray, starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists at some places, one after another."""
    sizes = starts[at + 1] - starts[at]
    return values[np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


DOC = {"n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups_sha256": T.StringType()}
SCHEMA = {"block": T.LongType(), **DOC, "held": T.ArrayType(T.IntegerType()), "times": T.ArrayType(T.IntegerType()), "keys": T.ArrayType(T.StringType()), "a": T.ArrayType(T.IntegerType()), "b": T.ArrayType(T.IntegerType()), "n": T.ArrayType(T.LongType())}


def blocks(docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """Texts encoded: a row a document and a row a block, in the shared folder.

    A document: block, doc_id, its sizes and checksum, the numbers of the groups it holds (`held`)
    and how often. A block: its groups by number (`keys`) and, of each pair of ids, how many of its
    documents hold it. A block ends with the document that fills it, or with its partition.
    """
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, count = encoders(*shared.value), TaskContext.get().partitionId(), 0
        kind, rows, ids, size = None, [], [], 0
        schema = None

        def flush() -> pa.RecordBatch:
            e.learn([w for words in rows for w in words])
            words_of = [np.fromiter(map(e.words.__getitem__, words), np.int64, len(words)) for words in rows]
            sizes = np.concatenate(e.sizes) if e.sizes else np.zeros((0, 5), np.int64)
            of, of_starts = np.concatenate([*e.of, np.zeros(0, np.int64)]), np.concatenate(([0], np.cumsum(sizes[:, 2])))
            linked, linked_starts = _flat(e.linked)
            holders = np.zeros(len(e.pairs), np.int64)
            held, times, made, digests = [], [], [], []
            for words in words_of:
                whole = sizes[words].sum(axis=0)
                if not len(words) or whole[4] < len(words):
                    words, whole = words[:0], np.zeros(5, np.int64)
                found, n = np.unique(_take(of, of_starts, words), return_counts=True)
                holders[np.unique(_take(linked, linked_starts, found))] += 1
                held.append(found)
                times.append(n)
                made.append(whole[:4])
                digests.append(hashlib.sha256(";".join(map(e.texts.__getitem__, words.tolist())).encode()).hexdigest() if len(words) else "")
            used = np.unique(np.concatenate(held))
            pairs, some = np.array(list(e.pairs), np.int32).reshape(-1, 2), np.flatnonzero(holders)
            n, code = len(rows), part << 32 | count
            made = np.array(made, np.int64).reshape(-1, 4)
            lists = lambda x, t: pa.array([*x, None], pa.list_(t))
            last = lambda x, t: pa.array([None] * n + [x], pa.list_(t))
            columns = [
                pa.concat_arrays([*ids, pa.nulls(1, kind)]), pa.array([code] * (n + 1), pa.int64()), *(pa.array([*made[:, k].tolist(), None], pa.int64()) for k in range(4)), pa.array([*digests, None], pa.string()),
                lists([np.searchsorted(used, h).astype(np.int32) for h in held], pa.int32()), lists([t.astype(np.int32) for t in times], pa.int32()),
                last([e.names[g] for g in used.tolist()], pa.string()), last(pairs[some, 0], pa.int32()), last(pairs[some, 1], pa.int32()), last(holders[some], pa.int64()),
            ]
            if len(e.words) > KNOWN:
                e.forget()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", *SCHEMA])

        for batch in batches:
            kind = batch.schema.field(0).type
            first = 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                rows.append(e.split(text) if text else [])
                size += len(text or "")
                if size >= BLOCK:
                    ids.append(batch.column(0).slice(first, i + 1 - first))
                    yield flush()
                    rows, ids, size, first, count = [], [], 0, i + 1, count + 1
            if first < batch.num_rows:
                ids.append(batch.column(0).slice(first))
        if rows:
            yield flush()

    path = scratch(docs.sparkSession, "aligned")
    docs.select("doc_id", "text").mapInArrow(run, typed(docs, "doc_id", **SCHEMA)).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(a, b, n, best) of each pair of ids that any document holds linked: n documents; best: whether no other pair of its A id has more."""
    each = encoded.where("keys is not null").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    pairs = checkpoint(each.groupBy("a", "b").agg(F.sum("n").alias("n")))
    return pairs.join(pairs.groupBy("a").agg(F.max("n").alias("most")), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def group_links(encoded: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """(key, a, b, places) of each distinct group and each pair that overlaps in it, at so many places."""
    shared = encoded.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoders(*shared.value)
        for batch in batches:
            keys, a, b, n = [], [], [], []
            for key in batch.column(0).to_pylist():
                counted: dict[tuple[int, int], int] = {}
                for p in e.links(key):
                    counted[p] = counted.get(p, 0) + 1
                keys += [key] * len(counted)
                a += [p[0] for p in counted]
                b += [p[1] for p in counted]
                n += counted.values()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], ["key", "a", "b", "places"])

    distinct = encoded.where("keys is not null").select(F.explode("keys").alias("key")).distinct()
    return distinct.mapInArrow(run, "key string, a int, b int, places long")


def aligned(docs: DataFrame, files: tuple[str, bytes]) -> DataFrame:
    """A row a document: its tokens, groups and links, how many links are their A id's best, the sum of the links' counts, the groups' checksum.

    A link's count: how many documents hold its pair of ids linked; rows that repeat count each.
    Null and empty texts, and those whose tokens don't spell their bytes, have zeros and an empty
    checksum, and count nowhere. Rows without an id are documents too. An empty table gives no
    rows, other columns are not read.
    """
    encoded = blocks(docs, files)
    counted = known_few(pair_counts(encoded))
    summed = group_links(encoded, files).join(counted, ["a", "b"]).groupBy("key").agg(F.sum(F.col("places") * F.col("n")).alias("total"), F.sum(F.when(F.col("best"), F.col("places")).otherwise(0)).alias("n_best"))
    numbered = encoded.where("keys is not null").select("block", F.posexplode("keys").alias("at", "key"))
    per_block = numbered.join(summed, "key").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "total", "n_best"))).alias("g"))
    values = per_block.select(F.col("block").alias("of"), F.col("g.total").alias("total"), F.col("g.n_best").alias("n_best"))
    rows = encoded.where("keys is null").select("block", "doc_id", *DOC, "held", "times")
    kinds = typed(docs, "doc_id", n_a=T.LongType(), n_b=T.LongType(), n_groups=T.LongType(), n_links=T.LongType(), n_best=T.LongType(), count_sum=T.LongType(), groups_sha256=T.StringType())

    def finish(documents: pa.Table, found: pa.Table) -> pa.Table:
        """The documents of a block with the values of its groups."""
        held, times = (documents[x].combine_chunks() for x in ("held", "times"))
        ends = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))
        sums = []
        for name in ("n_best", "total"):
            of_group = found[name].combine_chunks().flatten().to_numpy() if found.num_rows else np.zeros(0, np.int64)
            parts = np.concatenate(([0], np.cumsum(of_group[held.flatten().to_numpy()] * times.flatten().to_numpy())))
            sums.append(pa.array(parts[ends[1:]] - parts[ends[:-1]], pa.int64()))
        return pa.table([documents["doc_id"], *(documents[x] for x in ("n_a", "n_b", "n_groups", "n_links")), *sums, documents["groups_sha256"]], names=kinds.names)

    return rows.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(finish, kinds)
