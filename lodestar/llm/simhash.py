"""Near duplicates by SimHash: an inverted index of byte positions with count filtering, then components."""

from __future__ import annotations

from collections import deque
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import mapped, saved, scratch, with_group
from lodestar.llm.components import components

SEED = 42
BYTES = 8
#: The query's parameters.
SHINGLE, DISTANCE = 3, 2
#: Lists of up to so many fingerprints are tallied pair by pair; longer ones are cut by one more byte.
LIST = 1024
#: Lists of up to so many are compared in one step over all of them.
SHORT = 32
#: Hashes in memory at a time.
PART = 1 << 16


# --- fingerprints --------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash by XXH64 of a text's word shingles, repeats included.

    A-Z are lower-cased; words are runs of anything but ASCII white space. A bit is 1 if
    it is set in over half of the shingles' hashes. Fewer words than a shingle has are
    one shingle; no words give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both are ASCII-only on bytes
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    join, digest = b" ".join, xxhash.xxh64_digest
    ones, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for at in range(0, n, PART):
        some = words[at: at + PART + shingle - 1]
        hashes = b"".join([digest(join(s), SEED) for s in zip(*(some[i:] for i in range(shingle)))])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, BYTES), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (a signed long) of every whole text."""
    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, fp long")


# --- links ---------------------------------------------------------------------------

def position_sets(distance: int, size: int) -> list[tuple[int, ...]]:
    """The sets of ``size`` byte positions under which fingerprints are posted.

    Fingerprints within ``distance`` bits differ in as many bytes at most, so they agree at
    BYTES - distance positions, the guaranteed minimum. These are in order, so the first
    ``size`` of them leave room for the rest behind them: only such sets are needed.
    """
    if not 0 <= distance < BYTES:
        raise ValueError("the index needs a shared byte: distance must be 0 to 7")
    least = BYTES - distance
    return [s for s in combinations(range(BYTES), size) if s[-1] <= BYTES - 1 - (least - size)]


def _mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * (BYTES - 1 - p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ."""
    return np.bitwise_count(a ^ b)


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional bytes that pairs share."""
    different = np.atleast_1d(a ^ b)
    return BYTES - np.count_nonzero(np.ascontiguousarray(different).view(np.uint8).reshape(-1, BYTES), axis=1)


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs share the guaranteed minimum of positional bytes and, so verified, differ in ``distance`` bits at most."""
    found = tally(a, b) >= BYTES - distance
    found[found] = differing(*(np.broadcast_to(x, found.shape)[found] for x in (a, b))) <= distance
    return found


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within ``distance`` bits that span each component of distinct ``fps``, as pairs of row numbers, n - 1 at most."""
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            at = queue.popleft()
            found = near(fps[left], fps[at], distance)
            if found.any():
                links += [(int(at), int(x)) for x in left[found]]
                queue.extend(left[found])
                left = left[~found]
    return links


def links(fps: DataFrame, distance: int = DISTANCE, most: int = LIST) -> DataFrame:
    """a, b: links between different fingerprints that join up just what lies within ``distance`` bits.

    ``fps`` has distinct ``fp``. An inverted index has each fingerprint under its positional
    bytes, first at so many positions together that lists of evenly spread fingerprints are
    short, and the pairs of a list are tallied. Where bytes are common, and a list is longer
    than ``most``, its members are posted again with one more byte, and so on up to the
    guaranteed minimum: a list by that many bytes holds fingerprints that differ in
    ``distance`` bytes only, at most 2**16 for a distance of 2, whatever the corpus. Each
    pair that could be near is thus in a list that is tallied. A list yields a spanning
    forest of its near pairs, never all of them.
    """
    fps = fps.select("fp")
    total, size, out = fps.count(), 1, None
    while size < BYTES - distance and total >> 8 * size > most // 16:
        size += 1
    rows = fps.select("fp", F.explode(F.array(*[F.lit(_mask(s)).cast("long") for s in position_sets(distance, size)])).alias("mask"))
    while True:
        rows = rows.withColumn("shared", F.col("fp").bitwiseAND(F.col("mask")))
        if size == BYTES - distance:
            here = verified(rows, distance)
            return here if out is None else out.unionByName(here)
        rows = saved(rows)
        sizes = saved(rows.groupBy("mask", "shared").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        n = rows.count()
        listed = with_group(rows, sizes, ["mask", "shared"], "size", n)
        here = saved(verified(listed.where(F.col("size") <= most), distance))
        out = here if out is None else out.unionByName(here)
        if not sizes.where(F.col("size") > most).limit(1).count():
            return out
        size += 1
        wider = {_mask(s): [_mask(t) for t in position_sets(distance, size) if t[:-1] == s] for s in position_sets(distance, size - 1)}
        longer = F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.array(*[F.lit(m).cast("long") for m in x]).cast("array<long>") for pair in wider.items() for x in pair])
        rows = listed.where(F.col("size") > most).select("fp", F.explode(longer[F.col("mask")]).alias("mask"))


def verified(posted: DataFrame, distance: int) -> DataFrame:
    """a, b: a spanning forest of what is near in each list of ``posted`` (mask, shared, fp)."""
    lists = posted.select("mask", "shared", "fp").repartition("mask", "shared").sortWithinPartitions("mask", "shared", "fp")

    def verify(batches):
        def tallied(mask, shared, fp):
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fp)]])
            size = ends - starts
            rest = np.repeat(np.where(size <= SHORT, ends, 0), size) - np.arange(len(fp))
            one, two = [], []
            for step in range(1, SHORT):
                at = np.flatnonzero(rest > step)
                at = at[near(fp[at], fp[at + step], distance)] if len(at) else at
                one.append(at)
                two.append(at + step)
            for a, b in zip(starts[size > SHORT].tolist(), ends[size > SHORT].tolist()):
                found = np.array(spanning(fp[a:b], distance), dtype=np.int64).reshape(-1, 2) + a
                one.append(found[:, 0])
                two.append(found[:, 1])
            a, b = (fp[np.concatenate(x)].view(np.int64) for x in (one, two))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch["mask"].to_numpy(), batch["shared"].to_numpy(), batch["fp"].to_numpy().view(np.uint64))
            if held and (held[-1][0][-1], held[-1][1][-1]) == (now[0][-1], now[1][-1]) == (now[0][0], now[1][0]):
                held.append(now)  # one list goes on through the whole batch
                continue
            all_of = tuple(map(np.concatenate, zip(*held, now)))
            # the last list may go on in the next batch
            last = np.flatnonzero((all_of[0] != all_of[0][-1]) | (all_of[1] != all_of[1][-1]))
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield tallied(*(x[:at] for x in all_of))
            held = [tuple(x[at:] for x in all_of)]
        if held:
            yield tallied(*map(np.concatenate, zip(*held)))

    return mapped(lists, verify, "a long, b long")


# --- groups --------------------------------------------------------------------------

def near_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links of at most ``distance`` differing bits reach.

    Rows with one fingerprint are linked, null and empty texts too (fingerprint zero). A
    null doc_id takes part and is never a component_id, unless a component has no other.
    Distinct fingerprints are indexed, so copies cost nothing. No rows: no rows.
    """
    return linked(saved(fingerprints(docs, shingle)), distance)


def linked(rows: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``rows`` (doc_id, fp; a saved table) with component_id, as near_groups() has them."""
    with scratch(rows.sparkSession) as keep:
        groups = keep(saved(_groups(rows, distance)))
    return with_group(rows, groups, ["fp"], "copies", rows.count()).select("doc_id", "fp", "component_id")


def _groups(rows: DataFrame, distance: int) -> DataFrame:
    """fp, copies and component_id of each fingerprint of ``rows`` (doc_id, fp)."""
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    labels = components(saved(links(fps.select("fp"), distance)))
    labelled = saved(fps.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    parts = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    return with_group(labelled, parts, ["label"], "fps", labelled.count()).select("fp", "copies", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The query: doc_id, fingerprint in hex, component_id, as near_groups() has them; other columns are not read."""
    return near_groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
