"""Best-fit packing of token pieces by bin completion with branch and bound.

Packing only needs to know how many pieces there are of each length, which is a histogram of at most
``capacity`` rows however large the corpus is. A best-fit packing is the first incumbent. Bins are
completed around the largest length left: undominated fillings of the room beside it are enumerated, the
fullest first, and tried in turn, and branches are cut that waste more than a better packing may. Where the
search ends before it is through, wasteful bins are emptied and completed anew. Whole runs of equal bins
are made at once, so the plan is a short list of patterns. Spark then gives each piece its rank among
the pieces of its length, and the rank gives its sequence and offset.
"""

from __future__ import annotations

import base64
import json
import random
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pingmill.functions.storage import materialise

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one length and salt that one task ranks, about.
RANKED_ROWS = 50_000
#: Steps of the search with backtracking: lengths looked at and fillings begun.
WORK = 2_000_000
#: How often bins are emptied and completed anew, how many patterns of the most wasteful and of all at a time, and steps of each such search.
ROUNDS, REOPENED, AGAIN = 3_000, 4, 500
Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many bins, and (length, number in each bin) from the longest


def _encoding(ranks_path: str | None, json_path: str | None = None):
    """The vocabulary of the rank file with the added tokens of the JSON file, which stand for themselves wherever a text has them."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    with open(json_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: r for p, r in ranks.items() if r not in added.values()}, special_tokens=added)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: the first holds what the full ones leave."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, end_id: int = 0) -> DataFrame:
    """Tokenises whole texts (null: empty), adds ``end_id``, and cuts texts longer than ``capacity``.

    ``ranks_path`` is the rank file of the vocabulary, the one that byte_bpe_50k.json holds by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(_encoding(ranks_path).encode, allowed_special="all")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(np.asarray(encode(text.as_py() or ""), dtype="<u4"), np.uint32(end_id))
                out += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# --- bin completion on the histogram -------------------------------------------------------------


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit by falling length: each piece goes to the fullest bin that has room, whole runs of equal bins at once."""
    rooms: dict[int, list[Pattern]] = {capacity: []}  # bins by the room left
    for x in sorted(histogram, reverse=True):
        n = histogram[x]
        for room in sorted(r for r in rooms if x <= r < capacity):
            each, held, rooms[room] = room // x, rooms[room], []
            for times, items in held:
                full = min(times, n // each)
                part = min(1, times - full) if n - full * each else 0
                for many, k in ((full, each), (part, n - full * each)):
                    if many:
                        rooms.setdefault(room - k * x, []).append((many, (*items, (x, k))))
                        n -= many * k
                if times > full + part:
                    rooms[room].append((times - full - part, items))
        each = capacity // x
        for many, k in ((n // each, each), (1, n % each)):
            if many and k:
                rooms.setdefault(capacity - k * x, []).append((many, ((x, k),)))
    return [bin_ for held in rooms.values() for bin_ in held]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs.

    The greatest of the sum; for each k the pieces over half the capacity with those of k to a half that do not
    fit beside them; and sums of dual-feasible weights: a piece over a (k+1)-th weighs its whole (k+1)-ths by k,
    with pieces below a threshold left out and those that fill all but less than it counted whole.
    """
    counts = np.zeros(capacity + 2, np.int64)
    counts[list(histogram)] = list(histogram.values())
    lengths = np.arange(capacity + 2)
    n, total = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * lengths))
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    large, middle = n[-1] - n[capacity - k + 1], n[capacity - k + 1] - n[half + 1]
    room = middle * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[np.minimum(k, half + 1)]
    found = max((large + middle + np.maximum(0, -(-(small - room) // capacity))).max(), -(-total[-1] // capacity))
    for parts in range(1, 13):
        times = (parts + 1) * lengths
        weight = np.where(times % capacity == 0, parts * lengths, times // capacity * capacity)  # of parts * capacity
        before, after = np.append(0, np.cumsum(counts * weight)), parts * capacity
        inner = before[capacity - k + 1] - before[np.minimum(k, capacity - k + 1)]
        found = max(found, int((-(-(large * after + inner) // after)).max()))
    return int(found)


def _sums(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For each place in ``lengths`` the sums up to ``room`` that the pieces from there on can make, as bits."""
    mask, made = (2 << room) - 1, [1]
    for x in reversed(lengths):
        bits, left, take = made[-1], min(counts[x], room // x), 1
        while left > 0:
            take = min(take, left)
            bits |= (bits << take * x) & mask
            left, take = left - take, 2 * take
        made.append(bits)
    return made[::-1]


def _fillings(counts: dict[int, int], room: int, most: int, work: list[int]) -> Iterator[tuple[int, tuple[tuple[int, int], ...]]]:
    """All undominated fillings of ``room`` that leave at most ``most``, the fullest first: (left, (length, number)...).

    A filling is dominated if a piece fits into what it leaves or can take the place of a shorter one in it.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    sums = _sums(lengths, counts, room)
    work[0] -= len(lengths)
    for left in range(min(most, room) + 1):
        stack = [(0, room - left, ())] if sums[0] >> (room - left) & 1 else []
        while stack and work[0] > 0:
            work[0] -= 1
            at, rest, items = stack.pop()
            if rest:
                while lengths[at] > rest:
                    at += 1
                x = lengths[at]
                for n in range(min(counts[x], rest // x) + 1):
                    if sums[at + 1] >> (rest - n * x) & 1:
                        stack.append((at + 1, rest - n * x, (*items, (x, n)) if n else items))
                continue
            used = dict(items)
            spare = [x for x in lengths if counts[x] > used.get(x, 0)] if left else []
            if not any(x <= left or any(y < x <= y + left for y in used) for x in spare):
                yield left, items


def _moves(counts: dict[int, int], capacity: int, spare: int, work: list[int]) -> Iterator[Pattern]:
    """All undominated bins around the longest piece left that waste at most ``spare`` together, each from as often as the pieces last down to once."""
    first, own = max(counts), dict(counts)
    own[first] -= 1
    for left, items in _fillings(own, capacity - first, spare, work):
        bin_ = dict(items)
        bin_[first] = bin_.get(first, 0) + 1
        pattern = tuple(sorted(bin_.items(), reverse=True))
        for times in range(min(*(counts[x] // n for x, n in pattern), spare // left if left else counts[first]), 0, -1):
            yield times, pattern


def _dive(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Completes each bin around the longest piece left by the fullest filling, as often as the pieces last."""
    counts, plan = dict(histogram), []
    while counts:
        times, pattern = next(_moves(counts, capacity, capacity * sum(counts.values()), [1 << 60]))
        plan.append((times, pattern))
        for x, n in pattern:
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
    return plan


def _bins(plan: list[Pattern]) -> int:
    return sum(times for times, _ in plan)


def _search(histogram: dict[int, int], capacity: int, best: list[Pattern], lower: int, work: int) -> tuple[list[Pattern], bool]:
    """Depth-first search with backtracking over (pattern, times), and whether it went through all; it ends after ``work`` steps.

    A branch is cut where its waste is more than a packing with a bin less than the best one may have.
    """
    counts, bins, budget = dict(histogram), _bins(best), [work]
    total = rest = sum(x * n for x, n in counts.items())
    used, plan = 0, []
    seen: dict[frozenset, int] = {}  # the fewest bins that led to what is left, for short histograms

    def spare() -> int:
        return (bins - 1 - used) * capacity - rest

    if not counts or spare() < 0:
        return best, True
    stack = [_moves(counts, capacity, spare(), budget)]
    while stack and budget[0] > 0:
        budget[0] -= 1
        move = next(stack[-1], None)
        deeper = False
        if move is None:
            stack.pop()
        else:
            plan.append(move)
            times, pattern = move
            used += times
            for x, n in pattern:
                rest -= times * n * x
                counts[x] -= times * n
                if not counts[x]:
                    del counts[x]
            if not counts:
                if used < bins:
                    best, bins = list(plan), used
                    if bins <= lower:
                        break
            elif spare() >= 0 and used + sum(n for x, n in counts.items() if 2 * x > capacity) < bins:
                key = frozenset(counts.items()) if len(counts) <= 64 else None
                deeper = key is None or seen.get(key, bins) > used
                if deeper and key is not None:
                    seen[key] = used
        if deeper:
            stack.append(_moves(counts, capacity, spare(), budget))
        elif plan:
            times, pattern = plan.pop()
            used -= times
            for x, n in pattern:
                rest += times * n * x
                counts[x] = counts.get(x, 0) + times * n
    return best, budget[0] > 0


def _pieces_of(plan: list[Pattern]) -> dict[int, int]:
    counts: dict[int, int] = {}
    for times, items in plan:
        for x, n in items:
            counts[x] = counts.get(x, 0) + times * n
    return counts


def _reopen(plan: list[Pattern], capacity: int, lower: int, rounds: int, work: int = AGAIN) -> list[Pattern]:
    """Empties some patterns at a time, the most wasteful among them, and completes their bins anew.

    What comes of it is kept if it has fewer bins, or as many and none of the waste is spread further, as the
    sum of the squares of the fillings tells: waste that gathers in few bins makes one of them needless in
    the end. The choice hangs on the round's number alone, so equal histograms give equal packings.
    """

    def order(part: list[Pattern]) -> tuple[int, int]:
        return _bins(part), -sum(times * sum(x * n for x, n in items) ** 2 for times, items in part)

    bins, draws = _bins(plan), random.Random(0)
    for _ in range(rounds):
        if bins <= lower:
            break
        by_waste = sorted(range(len(plan)), key=lambda i: sum(x * n for x, n in plan[i][1]))
        few = min(REOPENED, len(by_waste))
        chosen = {*draws.sample(by_waste[: 4 * REOPENED], few), *draws.sample(by_waste, few)}
        old = [plan[i] for i in sorted(chosen)]
        counts = _pieces_of(old)
        new = min(_dive(counts, capacity), old, key=order)
        if (least := lower_bound(counts, capacity)) < _bins(new):
            new, _ = _search(counts, capacity, new, least, work)
        if order(new) <= order(old):
            plan = [p for i, p in enumerate(plan) if i not in chosen] + new
            bins = _bins(plan)
    return plan


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, work: int = WORK, rounds: int = ROUNDS) -> list[Pattern]:
    """Patterns that hold every piece once, in as few bins as the search finds.

    The incumbent is the better of a best-fit packing and of one that completes each bin by its fullest filling.
    If it does not meet the lower bound, a search with backtracking goes through all undominated fillings, depth
    first, for ``work`` steps at most, and then ``rounds`` times bins are emptied and completed anew. The search is
    exact unless its steps end; callers see the gap by ``lower_bound``.
    """
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("a length must be from 1 to the capacity")
    lower, best = lower_bound(histogram, capacity), best_fit(histogram, capacity)
    if _bins(best) > lower:
        best = min(best, _dive(histogram, capacity), key=_bins)
    through = _bins(best) <= lower
    if not through:
        best, through = _search(histogram, capacity, best, lower, work)
    return best if through else _reopen(best, capacity, lower, rounds)


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, number in each bin, first sequence, offset) of each pattern's pieces.

    At most capacity patterns use up a length each, and a pattern has few distinct lengths, so the list is bounded.
    """
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, items in patterns:
        offset = 0
        for x, n in items:
            at = used.get(x, 0)
            out.append((x, at, at + times * n, n, sequence, offset))
            used[x] = at + times * n
            offset += x * n
        sequence += times
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` rows; every row is placed, repeated ones too."""
    spark = cut_pieces.sparkSession
    rows = cut_pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(64, sum(histogram.values()) // RANKED_ROWS)
    plan = spark.createDataFrame(
        places(complete_bins(histogram, capacity)), "length long, low long, high long, each long, first_sequence long, first_offset long"
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    slot = F.col("rank") - F.col("low")
    return (
        ranked.alias("r")
        .join(F.broadcast(plan).alias("p"), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select(
            "doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32",
            (F.col("first_sequence") + F.floor(slot / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + (slot % F.col("each")) * F.col("r.length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the end id alone; repeated rows are packed each;
    an empty table gives no rows; other columns of ``docs`` are not read.
    """
    return pack(materialise(pieces(docs, capacity, ranks_path), "pieces"), capacity)
