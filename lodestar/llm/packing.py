"""Best-fit packing of documents into token sequences by bin completion."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestar.llm.common import mapped, saved
from lodestar.llm.tokens import encoder, release

CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Steps that the search may take before it settles for the best plan so far; a step looks at one length.
STEPS = 4_000_000


# --- the solver: lengths and their counts only ---------------------------------------

@dataclass
class Plan:
    """Fillings with the number of sequences made from each; a filling is [(length, times), ...]."""

    capacity: int
    fillings: list[tuple[list[tuple[int, int]], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


class Budget:
    """Steps left to a search."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left >= 0


def dominated(filling: dict[int, int], waste: int, left: dict[int, int]) -> bool:
    """Whether some members of ``filling`` could give way to a longer one of ``left`` (all counts, the filling's too).

    A length y that is still there can take the place of members that add up to s if
    s <= y <= s + waste: what they need is then free for them elsewhere, and the room is used
    as well or better. Two members and more may be replaced at no gain, one only by a longer.
    ``sums`` has a bit for each sum of members, ``several`` for those of two and more.
    """
    sums, several = 1, 0
    for x, n in filling.items():
        for _ in range(n):
            several |= (several | (sums & ~1)) << x
            sums |= sums << x
    for y, n in left.items():
        if n > filling.get(y, 0):
            low = max(0, y - waste)
            span = (1 << y - low + 1) - 1  # sums from low to y
            if several >> low & span or sums >> low & span >> 1:
                return True
    return False


def fillings(left: dict[int, int], room: int, most_waste: int, budget: Budget) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Undominated fillings of ``room`` from ``left`` that waste ``most_waste`` at most, and their waste, the least first.

    Depth first over distinct lengths, as often as possible down to not at all. A branch ends
    where all that is left below cannot bring the waste down to what is allowed.
    """
    lengths = sorted((x for x, n in left.items() if n and x <= room), reverse=True)
    below = [0]
    for x in reversed(lengths):
        below.append(below[-1] + x * left[x])
    below.reverse()
    found = []
    stack = [(0, room, ())]
    while stack and budget.spend():
        k, rest, filling = stack.pop()
        while k < len(lengths) and lengths[k] > rest:
            k += 1
        if rest - below[k] > most_waste:
            continue
        if k == len(lengths):
            budget.spend(len(left))
            if not dominated(dict(filling), rest, left):
                found.append((filling, rest))
            continue
        x = lengths[k]
        for n in range(min(left[x], rest // x) + 1):  # the last one pushed, the largest number, comes first
            stack.append((k + 1, rest - n * x, (*filling, (x, n)) if n else filling))
    return sorted(found, key=lambda f: (f[1], [-x for x, _ in f[0]]))


def fewest(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: all tokens over the capacity, or more where long pieces cannot share a sequence.

    For a length a up to half: pieces over capacity - a stand alone; those over a half take a
    sequence each, whose room may hold pieces of a and more, and what these exceed it by
    needs more sequences.
    """
    if not counts:
        return 0
    x = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[k] for k in x.tolist()], dtype=np.int64)
    pieces, tokens = (np.concatenate([[0], np.cumsum(y)]) for y in (n, x * n))  # of the lengths before each
    half = int(np.searchsorted(x, capacity // 2, "right"))
    a = np.concatenate([[0], x[:half]])
    from_a, fits = np.searchsorted(x, a), np.searchsorted(x, capacity - a, "right")
    shared = pieces[fits] - pieces[half]
    room = capacity * shared - (tokens[fits] - tokens[half])
    more = np.maximum(0, -(-(tokens[half] - tokens[from_a] - room) // capacity))
    return int(max(-(-tokens[-1] // capacity), (pieces[-1] - pieces[fits] + shared + more).max()))


def _fit(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """The largest length that fits, as often as it does, again and again; ``lengths`` are those of ``left``, rising."""
    filling: dict[int, int] = {}
    i = bisect.bisect_right(lengths, room) - 1
    while room and i >= 0:
        x = lengths[i]
        if n := min(left[x], room // x):
            filling[x] = n
            room -= n * x
        i = min(i - 1, bisect.bisect_right(lengths, room) - 1)
    return filling


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """A sequence around the largest piece is filled by best fit and made as often as the counts allow."""
    plan, left = Plan(capacity), {x: n for x, n in counts.items() if n}
    lengths = sorted(left)
    while lengths:
        filling = _fit(lengths, left, capacity)
        times = min(left[x] // n for x, n in filling.items())
        for x, n in filling.items():
            left[x] -= n * times
            if not left[x]:
                lengths.pop(bisect.bisect_left(lengths, x))
        plan.fillings.append((sorted(filling.items(), reverse=True), times))
    return plan


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Packs ``counts`` (length: number) into as few sequences of ``capacity`` as a search of ``steps`` finds.

    Branch and bound, for one number of sequences after the other from the lower bound on: it
    fixes how much waste a plan may have in all. A node fills sequences around the largest
    piece left: it branches over the undominated fillings of the room beside it, the fullest
    first, and over how many sequences are made alike, the most first. A node whose waste
    adds up to more is cut, or whose rest was met before in as few sequences. The incumbent
    is the plan of best_fit(); with many pieces it mostly meets the lower bound, and no search
    is needed. ``steps`` are the only other bound: half of those left go to each number, and
    where they run out the plan may not be the best. Steps grow with distinct lengths, not
    with documents.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    for target in range(fewest(counts, capacity), best.sequences):
        budget = Budget(steps // 2)
        if plan := _within(counts, capacity, target, budget):
            return plan
        steps -= steps // 2 - max(budget.left, 0)
    return best


def _within(counts: dict[int, int], capacity: int, target: int, budget: Budget) -> Plan | None:
    """A plan of ``target`` sequences at most, if there is one within the budget."""
    total = sum(x * n for x, n in counts.items())
    seen: dict[tuple, int] = {}

    def branches(left, slack):
        """(filling, waste of one such sequence, times) of a node, in turn."""
        largest = max(left)
        rest = dict(left)
        rest[largest] -= 1
        for filling, waste in fillings(rest, capacity - largest, slack, budget):
            whole = Counter(dict(filling))
            whole[largest] += 1
            for times in range(min(min(left[x] // n for x, n in whole.items()), slack // waste if waste else total), 0, -1):
                yield whole, waste, times

    slack = target * capacity - total
    stack = [(counts, 0, slack, [], branches(counts, slack))] if slack >= 0 else []
    while stack and budget.spend(len(stack[-1][0])):
        left, used, slack, made, turn = stack[-1]
        branch = next(turn, None)
        if branch is None:
            stack.pop()
            continue
        filling, waste, times = branch
        rest = {x: m for x, n in left.items() if (m := n - filling[x] * times)}
        plan = [*made, (sorted(filling.items(), reverse=True), times)]
        if not rest:
            return Plan(capacity, plan)
        used, slack = used + times, slack - waste * times
        key = tuple(sorted(rest.items()))
        if seen.get(key, used + 1) <= used:
            continue
        seen[key] = used
        if used + fewest(rest, capacity) <= target:
            stack.append((rest, used, slack, plan, branches(rest, slack)))
    return None


@dataclass
class Places:
    """Where the r-th piece of a length goes: spans of ranks, sorted by (length, first rank)."""

    key: np.ndarray  # length << 44 | first rank
    first: np.ndarray
    times: np.ndarray  # pieces of this length in each sequence of the span
    sequence: np.ndarray  # first sequence of the span
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 44) | rank, "right") - 1
        nth = rank - self.first[i]
        return self.sequence[i] + nth // self.times[i], self.offset[i] + nth % self.times[i] * length


def places(plan: Plan) -> Places:
    rows, ranks, sequence = [], {}, 0
    for filling, n in plan.fillings:
        at = 0
        for x, times in filling:
            r = ranks.get(x, 0)
            rows.append((x << 44 | r, r, times, sequence, at))
            ranks[x] = r + n * times
            at += x * times
        sequence += n
    return Places(*np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T.copy())


# --- operators -----------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY,
                 path: str | None = None, keep: bool = True) -> DataFrame:
    """The pieces of each whole text's ids and end id: only those over ``capacity`` are cut.

    A null text is an empty one, a piece of its end id alone. Repeated rows give their
    pieces each, a null doc_id stays null. No rows: no pieces. A Python worker keeps its
    encoder for later tasks unless ``keep`` is false.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches):
        encode = encoder(vocabulary, path)
        end = struct.pack("<I", end_id)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b["doc_id"].to_pylist(), encode.encode(b["text"])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at: at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)
        if not keep:
            del encode
            release()

    return mapped(docs.select("doc_id", "text"), cut, PIECES)


def packed(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, whose lengths are 1 to ``capacity``.

    The driver gets one count per distinct length (at most ``capacity`` of them) and
    solves on those. Rows of a length are numbered by partition of ``pieces``, with the
    partitions' counts summed first, so a length shared by most rows is numbered by many tasks.
    Which of several pieces of one length takes which place is not defined. No rows: no rows.
    """
    columns = list(pieces.columns)
    kept = saved(pieces.toDF(*[f"col_{i}" for i in range(len(columns))]).withColumn("part", F.spark_partition_id()))
    size, names = f"col_{columns.index(length)}", [f"col_{i}" for i in range(len(columns))]
    parts = saved(kept.groupBy(size, "part").count())
    table = parts.groupBy(size).agg(F.sum("count").alias("n")).collect()  # at most `capacity` rows
    at = places(bin_completion({int(r[0]): int(r[1]) for r in table}, capacity))

    # of a length as many rows as there are parts
    before = Window.partitionBy(size).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(size, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("part_first"))
    nth = F.row_number().over(Window.partitionBy(size, "part").orderBy(*names))
    ranked = kept.withColumn("nth", nth).join(starts, [size, "part"])

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sequence, offset = at.of(b[size].to_numpy(zero_copy_only=False).astype(np.int64), b["rank"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = StructType([*kept.drop("part").schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    numbered = ranked.select(*names, (F.col("part_first") + F.col("nth") - 1).cast("long").alias("rank"))
    return mapped(numbered, place, schema).toDF(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, keep: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens.

    A null text is an empty one, a piece of its end id alone. Repeated rows are packed
    each. Columns other than doc_id and text are not read. ``keep``: as for token_pieces().
    """
    return packed(token_pieces(docs, keep=keep))
