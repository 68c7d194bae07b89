"""Byte-level BPE by Spark higher-order functions.

A word's bytes are a string of token characters, one a token, beside a string of the characters that each
adjacent pair merges to. As a merge's rank is its token's id, the least character is the next merge: a
fold merges, step by step, the leftmost pair of the least rank, and looks only the two new pairs up, in a
literal table from pairs to merged tokens. Spark splits each text into words with the pattern. The
vocabulary's own words and the commonest words of the corpus, encoded once, are broadcast; the other
words are folded once for each block of documents, where they are, so no document is shuffled. Decoding
concatenates the binary pieces of a word's ids, and the words' bytes make the text again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise
from pingmill.llm.words import commonest

#: Words that are encoded once and broadcast, with their ids about 20 MB.
COMMON = 600_000
#: Longer words, in bytes, are merged with a heap: the fold looks at all pairs at each step, so its time grows with the square.
LONG = 256
#: Words of a block of documents, about; each word of a block is folded once. A longer text is in a block of its own.
BLOCK = 1 << 20
#: Buckets of the table of about 100,000 pairs.
BUCKETS = 1 << 16
#: Characters that no token has: a pair that merges with nothing, the end of a word, and separators of the table.
NONE, EDGE, ENTRY, BUCKET = (chr(0x10FFFF - k) for k in range(4))


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def character(token: int) -> str:
    """Characters follow the ids, without the surrogates."""
    return chr(token + 1 if token + 1 < 0xD800 else token + 0x801)


def pair_table(ranks: dict[bytes, int]) -> Column:
    """Literal array of buckets by the CRC-32 of separator and pair: (separator, left, right, merged) of each pair in a string."""
    buckets = [""] * BUCKETS
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                entry = ENTRY + character(left) + character(right)
                buckets[zlib.crc32(entry.encode()) % BUCKETS] += entry + character(rank)
    return F.split(F.lit(BUCKET.join(buckets)), BUCKET)


def pieces_of(ranks: dict[bytes, int]) -> Column:
    """Literal array of the bytes of each id, in hexadecimal; binary ones would be made anew for each row."""
    by_id = {rank: piece.hex() for piece, rank in ranks.items()}
    return F.split(F.lit(",".join(by_id.get(k, "") for k in range(max(by_id) + 1))), ",")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: an aggregate over nothing copies no value, as an array's transform would."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda start, _: start, use)


def byte_table(ranks: dict[bytes, int]) -> Column:
    """Literal array of what each pair of bytes merges to, by left * 256 + right."""
    pairs = (ranks.get(bytes([left, right])) for left in range(256) for right in range(256))
    return F.split(F.lit(BUCKET.join(NONE if rank is None else character(rank) for rank in pairs)), BUCKET)


def _merged(table: Column, pair: Column) -> Column:
    """The token that a pair of tokens merges to, or NONE, which is put behind the bucket's entries with the pair."""

    def look(entry: Column) -> Column:
        bucket = F.get(table, F.pmod(F.crc32(entry.cast("binary")), F.lit(BUCKETS)).cast("int"))
        return _let(F.concat(bucket, entry, F.lit(NONE)), lambda b: F.substring(b, F.instr(b, entry) + 3, F.lit(1)))

    return _let(F.concat(F.lit(ENTRY), pair), look)


def encode_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of each of an array of words, by merges alone. The literals occur once: each copy in the plan would be read by every task."""
    letters = "".join(map(chr, range(256))), "".join(character(ranks[bytes([b])]) for b in range(256))

    def fold(word: Column, table: Column, pairs: Column) -> Column:
        return _ids(_let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), lambda data: _fold(F.translate(data, *letters), _byte_pairs(data, pairs), table)))

    return _let(pair_table(ranks), lambda table: _let(byte_table(ranks), lambda pairs: F.transform(words, lambda w: fold(w, table, pairs))))


def _byte_pairs(data: Column, pairs: Column) -> Column:
    """What the adjacent bytes of a string of one character a byte merge to."""
    return _let(F.transform(F.split(data, ""), F.ascii), lambda own: F.array_join(F.transform(own, lambda c, i: F.get(pairs, c * 256 + F.get(own, i + 1))), ""))


def decode_words(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of each of an array of arrays of ids."""
    return _let(pieces_of(ranks), lambda pieces: F.transform(ids, lambda own: F.unhex(F.array_join(F.transform(own, lambda k: F.get(pieces, k)), ""))))


def _ids(tokens: Column) -> Column:
    number = F.transform(F.split(tokens, ""), F.ascii)
    return F.when(tokens == "", F.array().cast("array<int>")).otherwise(F.transform(number, lambda c: c - F.when(c < 0xD800, 1).otherwise(0x801)))


def _fold(letters: Column, pairs: Column, table: Column) -> Column:
    rest, one = F.lit(1 << 30), F.lit(1)

    def start(tokens: Column) -> Column:
        return F.struct(tokens.alias("tokens"), F.concat(F.lit(NONE), pairs, F.lit(NONE)).alias("merged"))

    def merge(state: Column, best: Column, at: Column) -> Column:
        tokens, merged = state["tokens"], state["merged"]
        before = _merged(table, F.concat(F.substring(tokens, at - 1, one), best))
        after = _merged(table, F.concat(best, F.substring(tokens, at + 2, one)))
        return F.struct(
            F.concat(F.substring(tokens, one, at - 1), best, F.substring(tokens, at + 2, rest)).alias("tokens"),
            F.concat(F.substring(merged, one, at - 2), before, after, F.substring(merged, at + 2, rest)).alias("merged"),
        )

    def step(state: Column, _: Column) -> Column:
        least = F.array_min(F.split(state["merged"], ""))
        done = F.struct(state["tokens"].alias("tokens"), F.lit("").alias("merged"))  # steps that are left look at nothing
        search = _let(least, lambda x: F.when(x == NONE, done).otherwise(_let(F.instr(state["merged"], x), lambda at: merge(state, x, at))))
        return F.when(state["merged"] == "", state).otherwise(search)

    bounded = F.concat(F.lit(EDGE), letters, F.lit(EDGE))
    folded = _let(bounded, lambda tokens: F.aggregate(F.sequence(one, F.greatest(one, F.length(tokens) - 3)), start(tokens), step, lambda s: s["tokens"]))
    return _let(folded, lambda tokens: F.substring(tokens, F.lit(2), F.length(tokens) - 2))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids for a long word, in time n log n."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def common_words(split: Column, docs: DataFrame, limit: int = COMMON) -> DataFrame:
    """At most ``limit`` of the commonest words of the texts, with their counts over all documents."""
    counts = docs.select(F.explode(split).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return commonest(materialise(counts.where("n > 1"), "words"), limit)


def _binary(ids: pa.ListArray) -> pa.BinaryArray:
    """Lists of ids as little-endian unsigned 32-bit integers."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


class Known:
    """Encoded words as Arrow columns: word, ids, decoded. A word's number is its place."""

    def __init__(self, found: pa.Table, ranks: dict[bytes, int]):
        own = [(piece, rank) for piece, rank in ranks.items() if _utf8(piece)]  # one token, whatever merges would give
        vocabulary = pa.table({"word": pa.array([p.decode() for p, _ in own], pa.string()), "ids": pa.array([r.to_bytes(4, "little") for _, r in own], pa.binary()), "decoded": pa.array([p for p, _ in own], pa.binary())})
        found = found.combine_chunks()
        lists = found.column("ids").combine_chunks() if len(found) else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        common = pa.table({"word": found.column("word").cast(pa.string()), "ids": _binary(lists), "decoded": found.column("decoded").cast(pa.binary())})
        common = common.filter(pc.invert(pc.is_in(common.column("word"), vocabulary.column("word"))))
        self.table = pa.concat_tables([vocabulary, common]).combine_chunks()

    def __getstate__(self) -> bytes:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, self.table.schema) as stream:
            stream.write_table(self.table)
        return out.getvalue()

    def __setstate__(self, data: bytes) -> None:
        with pa.ipc.open_stream(data) as stream:
            self.table = stream.read_all().combine_chunks()

    def column(self, name: str) -> pa.Array:
        return self.table.column(name).chunk(0)


def _utf8(piece: bytes) -> bool:
    try:
        return bool(piece.decode())
    except UnicodeDecodeError:
        return False


BLOCKS = "doc_ids binary, known_ids binary, sizes binary, codes binary, words array<string>, longs array<array<int>>"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, common: int = COMMON, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, little-endian, if asked for).

    ``ranks_path``: a rank file; ``pattern``: what splits texts into words. Null and empty texts have no
    tokens; a null doc_id stays null. Repeated rows each give a row. An empty table gives no rows; other
    columns are not read. Texts with characters that the JVM's Unicode does not know are split in Python,
    whose tables are newer.
    """
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    ranks = load_ranks(ranks_path)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))
    spark = docs.sparkSession
    top = common_words(split, docs, common).where(F.octet_length("word") <= LONG).select("word", encode_words(F.array("word"), ranks).alias("one"))
    top = top.select("word", F.col("one")[0].alias("ids"), decode_words(F.col("one"), ranks)[0].alias("decoded"))
    known = spark.sparkContext.broadcast(Known(top.toArrow(), ranks))  # at most ``common`` short words

    def block(ids: pa.Array, words: pa.ListArray, own: dict[bytes, int]) -> pa.RecordBatch:
        sizes = words.value_lengths().to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, known.value.column("word")), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        number[new] = len(known.value.table) + np.arange(len(new))
        rest = coded.dictionary.take(pa.array(new))
        longs: list[list[int] | None] = [None] * len(rest)
        for k in np.flatnonzero(pc.binary_length(rest).to_numpy(zero_copy_only=False) > LONG).tolist():
            own.update({} if own else load_ranks(ranks_path))
            longs[k] = merge_long(rest[k].as_py().encode(), own)
        rest = pc.if_else(pa.array([x is None for x in longs], pa.bool_()), rest, "")
        codes = number[coded.indices.to_numpy(zero_copy_only=False)].astype("<i4")
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (ids.fill_null(0).to_numpy(zero_copy_only=False), valid, sizes.astype("<i8"), codes)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([rest.to_pylist()], pa.list_(pa.string())), pa.array([longs], pa.list_(pa.list_(pa.int32())))], names=["doc_ids", "known_ids", "sizes", "codes", "words", "longs"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, own = regex.compile(pattern).findall, {}
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return block(pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), own)

        for batch in batches:
            words, odd = batch.column(1), batch.column(2)
            if odd.null_count < len(odd):
                lists = words.to_pylist()
                words = pa.array([w if t is None else find(t) for w, t in zip(lists, odd.to_pylist(), strict=True)], pa.list_(pa.string()))
            ends, a = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)), 0
            while a < len(ends):
                before = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
                if held and size + ends[b - 1] - before > BLOCK:
                    yield out()
                    held, size = [], 0
                held.append((batch.column(0)[a:b], words[a:b]))
                size += ends[b - 1] - before
                a = b
        if held:
            yield out()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, valid, sizes, codes = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in enumerate(("<i8", "?", "<i8", "<i4")))
                own, decoded = batch.column(4)[k].values, batch.column(5)[k].values
                ends = np.append(0, np.cumsum(sizes))

                def texts(name: str, rest: pa.Array) -> list[memoryview]:
                    found = pa.concat_arrays([known.value.column(name).cast(pa.large_binary()), rest.cast(pa.large_binary())]).take(pa.array(codes))
                    at = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[ends].tolist()
                    data = memoryview(found.buffers()[2] or b"")
                    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

                encoded = texts("ids", _binary(own))
                sha = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (encoded, texts("decoded", decoded))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=~valid), pa.array([len(x) // 4 for x in encoded], pa.int64()), *(pa.array(s, pa.string()) for s in sha),
                        pa.array([bytes(x) if with_ids else None for x in encoded], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    odd = F.when((F.octet_length(text) > F.length(text)) & text.rlike(r"\p{Cn}"), text)
    found = docs.select(F.col("doc_id").cast("long"), F.when(odd.isNull(), split).otherwise(F.array().cast("array<string>")).alias("words"), odd.alias("odd")).mapInArrow(blocks, BLOCKS)
    ids = F.zip_with(encode_words(F.col("words"), ranks), F.col("longs"), lambda own, given: F.coalesce(given, own))
    encoded = found.select("doc_ids", "known_ids", "sizes", "codes", ids.alias("ids"))
    out = encoded.select("*", decode_words(F.col("ids"), ranks).alias("decoded")).mapInArrow(join, f"{RESULT}, ids binary")
    return out if with_ids else out.drop("ids")
