"""Token-id files: whole texts to ids, ids to Huffman-coded files in document order, and back."""

from __future__ import annotations

import gc
import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import huffman
from skein.llm.bpe import Merges
from skein.llm.shared import drop, partitions, read_files, ready, scratch, staged, table, write_files
from skein.llm.textvec import LOWER, chunks, rows_of

END = 1
#: Ids of a file, but for a longer document, which is a file of its own.
FILE_IDS = 2_000_000
#: Pieces whose ids a worker remembers; then it forgets those that it met once.
CACHE_PIECES = 500_000
#: Bytes of a text encoded at once.
BLOCK = 1 << 20
#: Bytes of a piece that is looked up in numpy; longer ones stand in a dictionary.
SHORT = 23
#: How the tokenizer cuts texts. Fixed value: others have their words taken whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _DIGIT, _MARK, _ODD, _WHOLE = range(6)
_loaded: dict = {}


def _kinds() -> np.ndarray:
    """The kind of each byte: apostrophes, controls and bytes of longer characters are odd."""
    out = np.full(256, _ODD, np.uint8)
    out[list(b" \t\n\v\f\r")] = _SPACE
    for b in range(0x21, 0x7F):
        out[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    out[ord("'")] = _ODD
    return out


_KINDS = _kinds()
#: Which low bytes of a little-endian word belong to a piece that has 0 to 8 bytes of it.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


class WordIds:
    """Ids of pieces of texts, each encoded once. For tokenizers that lower-case, drop white space and never join across it.

    A word stands between ASCII white space. Words of ASCII characters and Latin-1 letters, but apostrophes, are cut as
    the tokenizer does, into lower-cased letters, single digits and runs of marks; letters are merged side by side in
    numpy, as no other step changes them. Any other word, and one with `<|`, goes as it is through all of the
    tokenizer's steps. So the ids are those of the whole text. Pieces are compared by all of their bytes.
    """

    def __init__(self, path: str, end: int, most: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most = Tokenizer.from_file(path), end, most
        self.merges = Merges.of(path)
        with open(path, encoding="utf-8") as file:
            self.cuts = json.dumps(PATTERN) in file.read()
        self._clear()

    def _clear(self) -> None:
        self.bits = max(8, (2 * self.most).bit_length())
        # A row: the piece's bytes and, in the last one of them, their number; then its place, counted from 1.
        self.slots, self.held = np.zeros((1 << self.bits, 4), np.uint64), 0
        self.long: dict[bytes, int] = {}
        # Place 0 is the end of a document.
        self.first, self.size, self.ids = array("q", [0]), array("q", [1]), array("I", [self.end])
        self.used = np.zeros(self.most * 2, np.int32)

    def _forget(self) -> None:
        """Keeps the pieces that were met twice or more; counts are halved, so that pieces that no longer come go too."""
        keep = np.flatnonzero(self.used[: len(self.first)] >= 2)
        if len(keep) > self.most // 2:
            return self._clear()
        keep = np.union1d(keep, [0])
        ids, size = self._gather(keep)
        new = np.full(len(self.first), -1, np.int64)
        new[keep] = np.arange(len(keep))
        rows = self.slots[self.slots[:, 3] > 0]
        place = new[rows[:, 3].astype(np.int64) - 1]
        rows, place = rows[place >= 0], place[place >= 0]
        self.long = {w: int(new[k]) for w, k in self.long.items() if new[k] >= 0}
        end = np.cumsum(size)
        self.first, self.size, self.ids = array("q", (end - size).tobytes()), array("q", size.tobytes()), array("I", ids.tobytes())
        used = self.used[keep] // 2
        self.used = np.zeros(self.most * 2, np.int32)
        self.used[: len(keep)] = used
        self.bits = max(8, (2 * self.most).bit_length())
        self.slots, self.held = np.zeros((1 << self.bits, 4), np.uint64), 0
        self._insert(rows[:, :3], place)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, one after another, and how many each has."""
        first, known, store = (np.frombuffer(x, x.typecode) for x in (self.first, self.size, self.ids))
        size = known[at]
        end = np.cumsum(size)
        return store[np.repeat(first[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)], size

    def _count(self, at: np.ndarray) -> None:
        n = len(self.first)
        if n > len(self.used):
            self.used = np.append(self.used, np.zeros(n, np.int32))
        self.used[:n] += np.bincount(at, minlength=n).astype(np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] * _FACTORS[0]) ^ (keys[:, 1] * _FACTORS[1]) ^ (keys[:, 2] * _FACTORS[2])
        return (h ^ (h >> np.uint64(29))) * _FACTORS[0]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (self._hash(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each short piece, or -1."""
        out, at = np.full(len(keys), -1, np.int64), self._slot(keys)
        todo, mask = np.arange(len(keys)), (1 << self.bits) - 1
        mine = keys
        while len(todo):
            rows = self.slots[at]
            here = (rows[:, 0] == mine[:, 0]) & (rows[:, 1] == mine[:, 1]) & (rows[:, 2] == mine[:, 2])
            out[todo[here]] = rows[here, 3].astype(np.int64) - 1
            on = ~here & (rows[:, 3] > 0)
            todo, at, mine = todo[on], (at[on] + 1) & mask, mine[on]
        return out

    def _insert(self, keys: np.ndarray, place: np.ndarray) -> None:
        """Puts distinct pieces that aren't there into the first free slots from their hash on; slots are doubled before two thirds are taken."""
        if 3 * (self.held + len(keys)) > 2 << self.bits:
            rows = self.slots[self.slots[:, 3] > 0]
            self.bits += 1
            self.slots, self.held = np.zeros((1 << self.bits, 4), np.uint64), 0
            self._insert(rows[:, :3], rows[:, 3].astype(np.int64) - 1)
            return self._insert(keys, place)
        self.held += len(keys)
        todo, at, mask = np.arange(len(keys)), self._slot(keys), (1 << self.bits) - 1
        while len(todo):
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(todo), bool)
            mine[first] = True
            mine &= self.slots[at, 3] == 0
            self.slots[at[mine], :3], self.slots[at[mine], 3] = keys[todo[mine]], place[todo[mine]].astype(np.uint64) + np.uint64(1)
            todo, at = todo[~mine], (at[~mine] + 1) & mask

    def _add(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """New places with these ids."""
        start, end, n = len(self.ids), np.cumsum(size), len(self.first)
        self.first.frombytes((start + end - size).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        return np.arange(n, len(self.first))

    def _tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids that the tokenizer's own steps give each piece, and how many each has."""
        ids = [self.tokenizer.encode(p.decode("utf-8", "replace"), add_special_tokens=False).ids for p in pieces]
        return np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> None:
        """Gives places to distinct short pieces that have none."""
        letters = kind == _LETTER if self.merges else np.zeros(len(kind), bool)
        if letters.any():
            self._insert(keys[letters], self._add(*self.merges.encode(data, start[letters], size[letters])))
        rest = ~letters
        if rest.any():
            pieces = [data[i : i + n].tobytes() for i, n in zip(start[rest].tolist(), size[rest].tolist())]
            self._insert(keys[rest], self._add(*self._tokens(pieces)))

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, lower-cased but in words left whole, and start, end and kind of each piece."""
        raw = data[at[0] : at[-1]]
        n, low, kind = len(raw), LOWER[raw], _KINDS[raw]
        cut = np.zeros(n + 1, bool)
        cut[at - at[0]] = True
        lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        if len(lead):
            # Latin-1 letters; U+00D7 and U+00F7 are marks.
            second = raw[lead + 1]
            good = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7) & ~cut[lead + 1]
            lead, second = lead[good], second[good]
            kind[lead] = kind[lead + 1] = _LETTER
            low[lead + 1] = np.where(second <= 0x9E, second + 0x20, second)
        space = kind == _SPACE
        odd = np.flatnonzero((kind == _ODD) if self.cuts else ~space)
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        if len(special):
            odd = np.union1d(odd, special)
        if len(odd):
            edge = np.flatnonzero(np.diff(space, prepend=True) | cut[:n])
            word = np.unique(np.searchsorted(edge, odd, "right") - 1)
            begin, length = edge[word], np.append(edge[1:], n)[word] - edge[word]
            end = np.cumsum(length)
            inside = np.repeat(begin - (end - length), length) + np.arange(end[-1])
            kind[inside], low[inside] = _WHOLE, raw[inside]
        begins = cut[:n] | (kind == _DIGIT)
        begins[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)[: len(start)]
        some = kind[start] != _SPACE
        start, end = start[some], end[some]
        return low, start, end, kind[start]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and how many each has. at: where each text's bytes begin, with the end last.

        A text of over BLOCK bytes is taken in blocks that end at white space, or where a word longer than that ends.
        """
        out = []
        for i, j in chunks(at, BLOCK):
            if j - i > 1 or at[j] - at[i] <= BLOCK:
                out.append(self._encode(data, at[i : j + 1]))
                continue
            parts, begin, stop = [], int(at[i]), int(at[j])
            while begin < stop:
                end = min(begin + BLOCK, stop)
                while end < stop and not (here := np.flatnonzero(_KINDS[data[begin:end]] == _SPACE)).size:
                    end = min(end + BLOCK, stop)
                if end < stop:
                    end = begin + int(here[-1]) + 1
                parts.append(self._encode(data, np.array([begin, end]))[0][:-1])
                begin = end
            parts.append(np.array([self.end], parts[-1].dtype))
            ids = np.concatenate(parts)
            out.append((ids, np.array([len(ids)], np.int64)))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.first) > self.most:
            self._forget()
        low, start, end, kind = self._cut(data, at)
        size = end - start
        padded = np.zeros(len(low) + 32, np.uint8)
        padded[: len(low)] = low
        eight = np.ndarray((len(low) + 24,), "<u8", padded, strides=(1,))
        keys = np.stack([eight[start + k] & _LOW[np.clip(size - k, 0, 8)] for k in (0, 8, 16)], 1)
        keys[:, 2] |= np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        brief = size <= SHORT
        place = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(brief)
        place[short] = self._find(keys[short])
        new = short[place[short] < 0]
        while len(new):
            # Unlike pieces of one hash, if any, take turns.
            _, one = np.unique(self._hash(keys[new]), return_index=True)
            one = new[one]
            self._learn(keys[one], padded, start[one], size[one], kind[one])
            place[new] = self._find(keys[new])
            new = new[place[new] < 0]
        for k in np.flatnonzero(~brief).tolist():
            piece = low[start[k] : end[k]].tobytes()
            if piece not in self.long:
                self.long[piece] = int(self._add(*self._tokens([piece]))[0])
            place[k] = self.long[piece]
        bounds = np.searchsorted(start, at - at[0])
        count = np.diff(bounds) + 1
        place = np.insert(place, bounds[1:], 0)
        self._count(place)
        ids, sizes = self._gather(place)
        total, last = np.cumsum(sizes), np.cumsum(count) - 1
        return ids, np.diff(total[last], prepend=0)


def _encode(path: str, end: int, wide: bool, vocabulary: int, file_ids: int):
    """Rows of whole files' ids in order; the last row of a task holds its counts of ids."""
    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        # Ids make no cycles, and looking for some costs a fifth of the time.
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches):
        if path not in _loaded:
            _loaded[path] = WordIds(path, end)
        words, part = _loaded[path], TaskContext.get().partitionId()
        counts, seq, before, held = np.zeros(vocabulary, np.int64), 0, 0, []

        def row():
            nonlocal seq, before, held
            ids = np.concatenate([x[2] for x in held])
            out = [[part], [seq], [before], [[d for x in held for d in x[0]]], [np.concatenate([x[1] for x in held]).astype("<i8").tobytes()], [ids.astype("<u4" if wide else "<u2").tobytes()], [None]]
            seq, before, held = seq + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

        for batch, data, at in rows_of(batches, "text"):
            ids, sizes = words.encode(data, at)
            counts += np.bincount(ids, minlength=vocabulary)
            held.append((batch.column("doc_id").to_pylist(), sizes, ids))
            if sum(len(x[2]) for x in held) >= file_ids:
                yield row()
        if held:
            yield row()
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[part], [seq], [before], [None], [None], [None], [counts.tobytes()]], schema)], schema=schema)

    return run


def _add_counts(batches):
    total = None
    for batch in batches:
        for x in batch.column("counts"):
            n = np.frombuffer(x.as_buffer(), np.int64)
            total = n.copy() if total is None else total + n
    if total is not None:
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def _compress(shared, wide: bool):
    def run(batches):
        lengths, starts = shared.value
        code = huffman.codes(lengths)
        for batch in batches:
            for k in range(len(batch)):
                part, seq, before = (batch.column(n)[k].as_py() for n in ("part", "seq", "before"))
                head = {"part": part, "seq": seq, "start": starts[part] + before}
                ids = np.frombuffer(batch.column("ids")[k].as_buffer(), "<u4" if wide else "<u2").astype(np.int64)
                sizes = np.frombuffer(batch.column("sizes")[k].as_buffer(), "<i8")
                data = huffman.write(head, batch.column("doc_ids")[k].as_py(), sizes, ids, lengths, code)
                yield pa.RecordBatch.from_arrays([pa.array([data[: -len(huffman.ENDING)]], pa.binary())], ["data"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order to files under path.

    Documents are dealt by ranges of doc_id (nulls first; equal ids by their text's hash), so no task holds all of a
    repeated id; ids are kept in the shared folder until the counts of all of them give one code, and files are
    written by Spark's committer. Null and empty texts hold the end id alone. Other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ready(spark)
    vocabulary = max(end, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1
    wide = vocabulary > 1 << 16
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    rows = dealt.mapInArrow(_encode(tokenizer, end, wide, vocabulary, file_ids), "part long, seq long, before long, doc_ids array<long>, sizes binary, ids binary, counts binary")
    kept = scratch(spark, "ids")
    rows.write.option("compression", "zstd").parquet(kept)
    rows = spark.read.schema(rows.schema).parquet(kept)
    counts = np.zeros(vocabulary, np.int64)
    # At most as many rows as the vocabulary has ids.
    for i, n in rows.where("counts is not null").select("counts").mapInArrow(_add_counts, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    # One row for each partition that wrote.
    sums = rows.where("ids is not null").groupBy("part").agg(F.sum(F.octet_length("ids") / (4 if wide else 2)).cast("long")).collect()
    starts, total = {}, 0
    for part, n in sorted(sums):
        starts[part] = total
        total += n
    shared = spark.sparkContext.broadcast((huffman.code_lengths(counts), starts))
    write_files(rows.where("ids is not null").drop("counts").mapInArrow(_compress(shared, wide), "data binary"), "data", path, huffman.ENDING)
    drop(rows)


def _decode(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for x in batch.column("content"):
            head, doc_ids, sizes, ids = huffman.read(x.as_py())
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
            begin = ends - sizes
            each = [data[4 * i : 4 * j] for i, j in zip(begin.tolist(), ends.tolist())]
            rows = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begin + head["start"]), pa.array(sizes), pa.array([zlib.crc32(e) for e in each], pa.int64()), pa.array(each, pa.binary())], schema=schema)
            yield from (rows.slice(i, 2000) for i in range(0, len(rows), 2000))


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit integers) of each document in the files under path.

    Each file says where its ids stand among all, so a file is read once and needs no other.
    """
    ready(spark)
    return read_files(spark, path).select("content").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def token_table(spark, docs: DataFrame) -> DataFrame:
    """Writes docs (doc_id, text) to token files and gives what reading them back says of each document, but its ids."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).drop("ids")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    return token_table(spark, table(spark, sf_dir, "documents"))
