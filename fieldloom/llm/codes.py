"""Token ids in directly addressable codes: chunk levels, continuation bitmaps, rank directories.

An id is cut into chunks of eight bits, low bits first. Level 0 holds the first
chunk of every id; a bitmap marks the ids that go on, and level 1 holds the next
chunk of those alone, and so on. Each bitmap has a rank directory (set bits
before every 512th bit), so the place of a token's next chunk is a count, and
any token is read without decoding those before it.

A segment is one binary value: a fixed header, the document ids and their
offsets, then for each level its chunks, bitmap and directory. Segments hold
whole documents in ascending ``doc_id`` order, know how many tokens of their part
come before them, and are rows of a Parquet table, so that Spark's own writer places them in whatever store the cluster shares.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, new_table, sent_whole, small_batches, text_or_empty

MAGIC = b"DACSEG01"
HEADER = struct.Struct("<8sQQII")  # magic, documents, tokens, levels, reserved
RANK_EVERY = 512
SPACES = {"Regex": r"\s+"}
END_ID = 2
SEGMENT_TOKENS = 1 << 18
SEGMENT_SCHEMA = "part int, segment int, before long, n_docs long, n_tokens long, first_doc long, last_doc long, blob binary"
BROADCAST_PARTS = 1_000_000
BATCH_SEGMENTS = 4
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


# ---------------------------------------------------------------- the format
def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment from the documents' ids, their token counts and all token ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    offsets = np.zeros(len(doc_ids) + 1, dtype="<u8")
    np.cumsum(lengths, out=offsets[1:])
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        levels.append((rest.astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [HEADER.pack(MAGIC, len(doc_ids), len(ids), len(levels), 0), np.asarray(doc_ids, dtype="<i8").tobytes(), offsets.tobytes()]
    for chunks, more in levels:
        bits = np.packbits(more, bitorder="little")
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), rank_directory(bits).tobytes()]
    return b"".join(out)


def rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block of RANK_EVERY bits."""
    per_block = np.add.reduceat(POPCOUNT[bits].astype(np.uint32), np.arange(0, len(bits), RANK_EVERY // 8)) if len(bits) else np.zeros(0, np.uint32)
    return (np.cumsum(per_block) - per_block).astype("<u4")


class Segment:
    """A read view of one segment: ``token(i)`` for one id, ``ids()`` for all."""

    def __init__(self, blob: bytes):
        magic, n_docs, self.n_tokens, n_levels, _ = HEADER.unpack_from(blob, 0)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        at = HEADER.size
        self.doc_ids = np.frombuffer(blob, "<i8", n_docs, at)
        at += 8 * n_docs
        self.offsets = np.frombuffer(blob, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", blob, at)
            at += 8
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            n_bytes = (n + 7) // 8
            bits = np.frombuffer(blob, np.uint8, n_bytes, at)
            at += n_bytes
            n_blocks = -(-n // RANK_EVERY)
            self.levels.append((chunks, bits, np.frombuffer(blob, "<u4", n_blocks, at)))
            at += 4 * n_blocks

    def token(self, i: int) -> int:
        """The id at position ``i``, by one rank for each further chunk."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            first = block * RANK_EVERY // 8
            rank = int(directory[block]) + int(POPCOUNT[bits[first : i >> 3]].sum())
            i = rank + int(POPCOUNT[int(bits[i >> 3]) & ((1 << (i & 7)) - 1)])
        return value

    def ids(self) -> np.ndarray:
        """All ids in order."""
        rest = None
        for chunks, bits, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if rest is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
                value[more] |= rest << np.uint32(8)
            rest = value
        return rest


# -------------------------------------------------------------- tokenization
class FlatWords:
    """Words in flat arrays, a fraction of a dict's memory: found by their hash, then compared byte by byte."""

    def __init__(self):
        self.raw = np.zeros(0, dtype=np.uint8)
        self.ends = np.zeros(1, dtype=np.int64)
        self.hashes = np.zeros(0, dtype=np.int64)  # ascending
        self.places = np.zeros(0, dtype=np.int32)  # of the words with these hashes, in the order of ``add``

    @staticmethod
    def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, and where each word begins and ends; words hold no white space."""
        raw = np.frombuffer(("\n".join(words) + "\n").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.flatnonzero(raw == 10)
        return raw, np.concatenate([[0], ends[:-1] + 1]), ends

    @staticmethod
    def hashed(words: list[str]) -> np.ndarray:
        return np.fromiter(map(hash, words), dtype=np.int64, count=len(words))

    def add(self, words: list[str]) -> None:
        """Puts ``words`` after those that are here. Of words with one hash only the first is found."""
        n = len(self.ends) - 1
        raw, first, end = self.flat(words)
        self.raw = np.concatenate([self.raw, raw[raw != 10]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(end - first)])
        hashes, own = np.unique(self.hashed(words), return_index=True)
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), dtype=bool)
        new[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] != hashes[at < len(self.hashes)]
        self.places = np.insert(self.places, at[new], (own[new] + n).astype(np.int32))
        self.hashes = np.insert(self.hashes, at[new], hashes[new])

    def find(self, words: list[str]) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self.hashes) or not words:
            return np.full(len(words), -1, dtype=np.int64)
        hashes = self.hashed(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = self.places[at].astype(np.int64)
        raw, own, end = self.flat(words)
        first = self.ends[places]
        n = self.ends[places + 1] - first
        same = (self.hashes[at] == hashes) & (n == end - own)
        some = np.flatnonzero(same)
        if len(some):
            stop = np.cumsum(n[some])
            step, before = np.arange(int(stop[-1])), stop - n[some]
            differ = raw[np.repeat(own[some] - before, n[some]) + step] != self.raw[np.repeat(first[some] - before, n[some]) + step]
            same[some[np.searchsorted(stop, np.flatnonzero(differ), side="right")]] = False
        return np.where(same, places, -1)


class PieceEncoder:
    """Ids of whole texts through the tokenizer, each distinct word encoded once, many texts at a time.

    The tokenizer cuts a normalised text into pieces that hold no white space and
    never affect each other, so the ids of what stands between white space can be
    kept. Texts that hold one of its special tokens, and those whose lower case or
    white space differs between the libraries, go to the tokenizer whole. Once
    ``keep`` words are known, others are encoded without being kept. The first
    ``fast`` words, mostly the common ones, are in a dict, with the newest; the
    others are in flat arrays.
    """

    ODD = "Σİ\x1c\x1d\x1e\x1f\u180e"
    JOINED = 2048
    RUN_CHARS = 1 << 19

    def __init__(self, path: str, keep: int = 500_000, fast: int = 1 << 16, newest: int = 1 << 14):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens") or []] + list(self.ODD)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps = pre.get("pretokenizers", [pre])
        forms = norm.get("normalizers", [norm])
        plain = [n.get("type") for n in forms] == ["NFC", "Replace", "Lowercase"] and forms[1].get("pattern") == SPACES and forms[1].get("content") == " "
        self.by_word = bool(plain and len(steps) == 2 and steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1].get("type") == "ByteLevel")
        self.keep, self.fast, self.newest = keep, fast, newest
        # bytes of each token, as a byte-level vocabulary has a sign for each; 0 for those that are no run of bytes
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = (spec.get("model") or {}).get("end_of_word_suffix") or ""
        self.lengths = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
        for token, number in vocab.items():
            self.lengths[number] = 0 if token in self.special else len(token.removesuffix(suffix))
        self.n = 0  # words that have a number
        self.known: dict[str, int] = {}
        self.flat = FlatWords()  # words with the numbers from ``fast`` on
        self.table = np.zeros(1 << 20, dtype=np.uint32)
        self.ends = np.zeros(1 << 18, dtype=np.int64)  # where the ids of word i + 1 end; word 0 has none

    def learn(self, words: list[str]) -> None:
        """Encodes words in runs joined by a space, and cuts the ids by the word that each came from."""
        for at in range(0, len(words), self.JOINED):
            run = words[at : at + self.JOINED]
            ids, counts = self.cut_by_length(run) or self.cut_by_place(run)
            n, first = self.n, int(self.ends[self.n])
            while first + len(ids) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            while n + len(run) >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.table[first : first + len(ids)] = ids
            self.ends[n + 1 : n + 1 + len(run)] = first + np.cumsum(counts)
            self.known.update(zip(run, range(n, n + len(run)), strict=True))
            self.n += len(run)

    def cut_by_length(self, run: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """All ids and how many each word has, by the tokens' bytes; none where a word doesn't end with a token."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(run)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        raw, begins, ends = FlatWords.flat(run)
        word_ends, token_ends = np.cumsum(ends - begins), np.cumsum(self.lengths[ids])
        last = np.searchsorted(token_ends, word_ends)
        if not len(ids) or token_ends[-1] != word_ends[-1] or (token_ends[last] != word_ends).any() or (self.lengths[ids] == 0).any():
            return None
        return ids, np.diff(last, prepend=-1)

    def cut_by_place(self, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the places in the text that the tokenizer gives."""
        encoded = self.tokenizer.encode(" ".join(run), add_special_tokens=False)
        begins = np.cumsum([0, *[len(w) + 1 for w in run[:-1]]])
        whose = np.searchsorted(begins, np.array([o[0] for o in encoded.offsets], dtype=np.int64), side="right") - 1
        return np.array(encoded.ids, dtype=np.uint32), np.bincount(whose, minlength=len(run))

    def __call__(self, text: str) -> np.ndarray:
        return self.run([text])[0]

    def each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; texts are taken together until they have RUN_CHARS signs."""
        run, held = [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= self.RUN_CHARS:
                yield from self.run(run)
                run, held = [], 0
        yield from self.run(run)

    def run(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the words of all are looked up together."""
        import unicodedata

        words, counts, whole = [], np.zeros(len(texts) + 1, dtype=np.int64), {}
        for k, text in enumerate(texts):
            if not self.by_word or any(s in text for s in self.special):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            own = text.lower().split()
            words += own
            counts[k + 1] = len(own)
        ids, ends = self.of_words(words)
        at = np.concatenate([[0], ends])[np.cumsum(counts)]
        return [whole[k] if k in whole else ids[at[k] : at[k + 1]] for k in range(len(texts))]

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and where those of each word end."""
        from itertools import islice, repeat

        kept = self.n
        which = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(which < 0)
        new = []
        if len(missing):
            own = [words[i] for i in missing]
            distinct = list(dict.fromkeys(own))
            places = self.flat.find(distinct)
            new = [distinct[i] for i in np.flatnonzero(places < 0)]
            self.learn(new)
            places = {w: p + self.fast if p >= 0 else self.known[w] for w, p in zip(distinct, places.tolist(), strict=True)}
            which[missing] = np.fromiter(map(places.__getitem__, own), dtype=np.int64, count=len(own))
        first = self.ends[which]
        counts = self.ends[which + 1] - first
        ends = np.cumsum(counts)
        at = np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.table[at]
        if new and self.n > self.keep:
            for word in new:
                del self.known[word]
            self.n = kept
        elif len(self.known) >= self.fast + self.newest:
            self.flat.add(list(self.known)[self.fast :])
            self.known = dict(islice(self.known.items(), self.fast))
        return ids, ends


@cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


# ------------------------------------------------------------------ operator
def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, segment_tokens: int) -> Iterator[pa.RecordBatch]:
    """Segments of one range partition, whose rows come in ascending ``doc_id`` order."""
    from pyspark import TaskContext

    encode, part = piece_encoder(path), TaskContext.get().partitionId()
    docs, lengths, parts, held, segment, before = [], [], [], 0, 0, 0

    def close() -> pa.RecordBatch:
        blob = pack(np.array(docs, dtype=np.int64), np.array(lengths, dtype=np.int64), np.concatenate(parts))
        row = (part, segment, before, len(docs), held, docs[0], docs[-1], blob)
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    end = np.array([end_id], dtype=np.uint32)
    for batch in batches:
        texts = (text.as_py() for text in batch.column("text"))
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.each(texts), strict=True):
            docs.append(doc)
            lengths.append(len(ids) + 1)
            parts += [ids, end]
            held += len(ids) + 1
            if held >= segment_tokens:
                yield close()
                docs, lengths, parts, held, segment, before = [], [], [], 0, segment + 1, before + held
    if docs:
        yield close()


def write_codes(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write segments in ascending ``doc_id`` order to ``path``.

    Null texts are empty, and an empty text is its end id alone. Rows with a
    null ``doc_id`` come first, under the id -2^63. Rows that repeat an id are
    kept, next to each other in the order of their texts. An empty table writes a table without rows. Other
    columns are not read. A segment closes once it holds ``segment_tokens``
    tokens, so a task holds one segment and one document at a time.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), text_or_empty().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    task = partial(encode_batches, path=tokenizer_path, end_id=end_id, segment_tokens=segment_tokens)
    with small_batches(docs.sparkSession):
        ordered.mapInArrow(task, SEGMENT_SCHEMA).write.parquet(path)


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    piece_encoder.cache_clear()  # the files are written; workers live on, and later stages would carry the words
    for batch in batches:
        for start, blob in zip(batch.column("start").to_pylist(), batch.column("blob"), strict=True):
            seg = Segment(blob.as_py())
            raw, at = seg.ids().astype("<u4").tobytes(), seg.offsets
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seg.doc_ids, pa.int64()),
                    pa.array(at[:-1] + start, pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def placed(table: DataFrame) -> DataFrame:
    """The segments of ``table`` with ``start``, the count of all tokens before them.

    A segment knows the tokens before it in its part, so only the parts' totals, a
    row for each task that wrote, are summed up and sent to the segments.
    """
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    first = (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("first")
    return table.join(sent_whole(cut(totals.select("part", first)), BROADCAST_PARTS), "part").withColumn("start", F.col("first") + F.col("before")).drop("first")


def read_codes(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the segments at ``path``.

    ``start`` counts the ids of all documents before it. Segments are decoded where
    they are read, a few at a time, as each is large; nothing is exchanged but the parts' totals. The rows are kept.
    """
    table = placed(spark.read.schema(SEGMENT_SCHEMA).parquet(path))
    with small_batches(spark, BATCH_SEGMENTS):
        return cut(table.select("start", "blob").mapInArrow(decode_batches, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def tokens_at(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(position, token_id) for the global positions in ``wanted`` (position).

    Each position goes to the segment that covers it by an equi-join on
    fixed-width blocks of positions, and only that token is read. Positions
    outside the corpus, and null ones, return no row.
    """
    width = SEGMENT_TOKENS
    table = placed(spark.read.schema(SEGMENT_SCHEMA).parquet(path))
    table = table.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width))))
    asked = wanted.select(F.col("position").cast("long").alias("position")).where("position >= 0").withColumn("block", F.floor(F.col("position") / width))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    found = asked.join(table, "block").where(inside).select("position", "start", "blob")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, first = batch.column("position").to_pylist(), batch.column("start").to_pylist()
            ids = [Segment(b.as_py()).token(p - s) for p, s, b in zip(pos, first, batch.column("blob"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(ids, pa.int64())], ["position", "token_id"])

    return found.mapInArrow(pick, "position long, token_id long")


def token_codes(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as codes to ``path`` (a new table in the shared folder by default) and read them back."""
    spark = docs.sparkSession
    path = path or new_table(spark)
    write_codes(docs, path, tokenizer_path, **options)
    return read_codes(spark, path)
