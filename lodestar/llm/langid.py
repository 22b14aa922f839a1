"""Language by cross-parsing: suffix automata of labelled text, and the fewest normalised phrases."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import mapped

#: The bounded training sample of a language: so many whole texts at most, each of so many code
#: points at most. A language that has longer texts only is learned from its shortest.
SAMPLE_ROWS, SAMPLE_CHARS = 64, 1000
#: Texts are parsed in windows of so many code points, all of a part abreast, then joined up.
WINDOW = 512
#: Table steps (code points times languages) of a part.
PART_STEPS = 1 << 22
UNKNOWN = "und"


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Up to ``rows`` whole labelled texts per language of at most ``chars`` code points.

    In each of ``rows`` hash slots the row hashed lowest. A language without such a text
    gives its shortest one. Two passes with partial aggregation: the ids' hashes first,
    then the chosen texts, which are all that the driver gets. Rows that are held out, or
    whose lang, text or doc_id is null, are not looked at.
    """
    h = F.xxhash64(F.lit("language sample"), "doc_id")
    n = F.length("text")
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select("lang", "text", h.alias("h"), n.alias("size"))
    slot = F.when(F.col("size") <= chars, F.pmod("h", F.lit(rows))).otherwise(-1)  # longer texts: one slot
    order = F.struct(F.when(F.col("size") > chars, F.col("size")).otherwise(0).alias("over"), "h", "size")
    chosen = usable.groupBy("lang", slot.alias("slot")).agg(F.min(order).alias("least")).collect()  # rows + 1 a language
    short = {r["lang"] for r in chosen if r["slot"] >= 0}
    chosen = [(r["lang"], r["least"]["h"], r["least"]["size"]) for r in chosen if r["slot"] >= 0 or r["lang"] not in short]
    wanted = docs.sparkSession.createDataFrame(chosen, "of string, least long, chars int")
    found = (
        usable.join(F.broadcast(wanted), (F.col("lang") == F.col("of")) & (F.col("h") == F.col("least")) & (F.col("size") == F.col("chars")), "left_semi")
        .groupBy("lang", "h").agg(F.min("text").alias("text"))  # repeated rows of an id
    )
    out: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Edges of the automaton whose paths from state 0 spell just the substrings of ``symbols``."""
    edges: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
        last = new
    return edges


@dataclass
class Model:
    """Classes of code points, and one table of all languages' automata.

    Class 0 is everything but letters, 1 a letter that no sample has. The edge of state v by
    class c lies in slot ``base[v] + c`` if ``owner`` there is v: ``go`` is the next state.
    Where it does not, no longer match exists: a phrase ends, and the symbol starts the next
    one from the language's root. The slots of all states are laid into each other, so the
    table grows with the edges, not with states times letters.
    """

    languages: list[str]
    classes: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    go: np.ndarray
    roots: np.ndarray  # the first state of each language
    first: np.ndarray  # the state after a symbol at the root, by language and class
    bits: np.ndarray  # log2 of each sample's length: what naming one phrase costs
    foreign: np.ndarray  # phrases a letter of the other languages' samples, the most of any, by language


def letter_class(known: dict[str, int]) -> np.ndarray:
    """The class of each code point; the last entry is for those beyond the first plane."""
    out = np.zeros(0x10001, dtype=np.int32)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = known.get(c.lower()[0], 1)
    out[0x10000] = 1
    return out


def laid(edges: list[dict[int, int]], n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, owner and go: each state at the first place where its edges' slots are free, states of many edges first."""
    base = np.zeros(len(edges), dtype=np.int64)
    used = bytearray(sum(map(len, edges)) + 2 * n_classes + 64)
    owner, go = {}, {}
    free = start = 0
    for v in sorted(range(len(edges)), key=lambda v: -len(edges[v])):
        if not edges[v]:
            continue
        classes = sorted(edges[v])
        # a single edge takes the first free slot; several are sought from where such were laid last
        at = max((free if len(classes) == 1 else start) - classes[0], 0)
        tries = 0
        while True:
            if at + classes[-1] >= len(used):
                used.extend(bytes(len(used)))
            if not any(used[at + c] for c in classes):
                break
            at += 1
            tries += 1
        base[v] = at
        if tries > 16:
            start += tries // 2
        for c in classes:
            used[at + c] = 1
            owner[at + c], go[at + c] = v, edges[v][c]
        free = used.find(0, free)
        free = free if free >= 0 else len(used)
    size = int(base.max(initial=0)) + n_classes
    owners, gos = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
    slots = np.fromiter(owner, dtype=np.int64, count=len(owner))
    owners[slots] = np.fromiter(owner.values(), dtype=np.int32, count=len(owner))
    gos[slots] = np.fromiter(go.values(), dtype=np.int32, count=len(go))
    return base.astype(np.int32), owners, gos


def code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x10000)


def train(texts: dict[str, list[str]]) -> Model:
    """The model of ``{language: texts}``; every language needs a letter to be learned."""
    folded = {k: " ".join(v) for k, v in sorted(texts.items())}
    folded = {k: v for k, v in folded.items() if any(map(str.isalpha, v))}
    letters = sorted({c.lower()[0] for v in folded.values() for c in v if c.isalpha() and ord(c) < 0x10000})
    classes = letter_class({c: i + 2 for i, c in enumerate(letters)})
    n = len(letters) + 2
    edges, roots, bits = [], [], []
    for text in folded.values():
        symbols = classes[code_points(text)].tolist()
        own = suffix_automaton([s if s != 1 else 0 for s in symbols])
        roots.append(len(edges))
        bits.append(math.log2(len(symbols) + 1))
        edges += [{c: w + roots[-1] for c, w in out.items()} for out in own]
    base, owner, go = laid(edges, n)
    first = np.array([[edges[r].get(c, r) for c in range(n)] for r in roots], dtype=np.int32).reshape(len(roots), n)
    model = Model(list(folded), classes, base, owner, go, np.array(roots, dtype=np.int32), first, np.array(bits), np.ones(len(roots)))
    if len(folded) > 1:
        rate = phrases(model, list(folded.values())) / np.array([[sum(map(str.isalpha, v))] for v in folded.values()])
        np.fill_diagonal(rate, 0)
        model.foreign = np.minimum(rate.max(axis=0), 1.0)
    return model


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns).

    A part of a text begins in the state in which the one before ended. The windows of a
    part are parsed abreast, each from the root at first. Then each is parsed anew from the
    state in which the window before it ended, as far as the states differ, until none do:
    the phrases are those of the whole text.
    """
    n = len(model.languages)
    out = np.ones((len(texts), n))  # the last phrase is open
    most = max(WINDOW, PART_STEPS // max(1, n))
    some: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        symbols = model.classes[code_points(text)]
        if len(symbols) > most:
            state = model.roots.copy()
            for at in range(0, len(symbols), most):
                ended, state = _parsed(model, [symbols[at: at + most]], state[:, None])
                out[i] += ended[:, 0]
                state = state[:, 0]
            continue
        some.append((i, symbols))
        held += len(symbols)
        if held >= most:
            out[[k for k, _ in some]] += _parsed(model, [x for _, x in some], model.roots[:, None])[0].T
            some, held = [], 0
    if some:
        out[[k for k, _ in some]] += _parsed(model, [x for _, x in some], model.roots[:, None])[0].T
    return out


def _parsed(model: Model, parts: list[np.ndarray], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each part, and each part's last state, by language; ``begin`` is the state before each, or before all."""
    n = len(model.languages)
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(parts)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    flat = np.concatenate([*parts, np.zeros(1, model.classes.dtype)])
    start = (np.cumsum(sizes) - sizes)[owner] + nth * WINDOW
    length = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
    begin = np.broadcast_to(begin, (n, len(parts)))
    last = begin.copy()
    ended = np.zeros((n, len(parts)))
    if not len(owner):
        return ended, last
    order = np.argsort(-length, kind="stable")  # windows that still run are the first ones
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    owner, nth, start, length = owner[order], nth[order], start[order], length[order]
    running = len(length) - np.searchsorted(length[::-1], np.arange(WINDOW), "right")
    language = np.arange(n)[:, None]

    def step(state, symbols, which):
        slot = model.base[state] + symbols
        match = model.owner[slot] == state
        return np.where(match, model.go[slot], model.first[which, symbols]), match

    before = np.where(nth == 0, begin[:, owner], model.roots[:, None])  # of each window
    states, breaks = [], []
    state = before
    for at in range(WINDOW):
        k = running[at]
        if not k:
            break
        state, match = step(state[:, :k], flat[start[:k] + at], language)
        states.append(state)
        breaks.append(~match)
    previous = rank[np.maximum(order - 1, 0)]  # the place of the window before
    inner = nth > 0
    finals = np.empty(before.shape, dtype=np.int32)  # the state after each window
    for at, now in enumerate(states):
        done = length[: now.shape[1]] == at + 1
        finals[:, : now.shape[1]][:, done] = now[:, done]
    while True:
        true = np.where(inner, finals[:, previous], before)
        l, w = np.nonzero(true != before)
        if not len(l):
            break
        before = true
        state, at = true[l, w], 0
        while len(l):
            state, match = step(state, flat[start[w] + at], l)
            same = states[at][l, w] == state
            states[at][l, w] = state
            breaks[at][l, w] = ~match
            at += 1
            done = same | (length[w] <= at)
            new = done & ~same
            finals[l[new], w[new]] = state[new]
            l, w, state = l[~done], w[~done], state[~done]
    count = np.zeros((n, len(owner)))
    for b in breaks:
        count[:, : b.shape[1]] += b
    for i in range(n):
        ended[i] = np.bincount(owner, count[i], len(parts))
    tail = nth == windows[owner] - 1
    last[:, owner[tail]] = finals[:, tail]
    return ended, last


ASCII_LETTER = re.compile("[A-Za-z]").search


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(ASCII_LETTER(text) or any(map(str.isalpha, text)))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score, and whether the text is of a learned language at all.

    The score is how far the runner-up's cost lies above the winner's. A text is foreign if
    it takes more phrases than its letters would in another learned language, by three
    times the square root of that number and one: short texts are never foreign.
    """
    names, scores, fits = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if not model.languages:
        return names, scores, fits
    some = [i for i, t in enumerate(texts) if has_letter(t)]
    for at in range(0, len(some), 4096):
        part = some[at: at + 4096]
        counts = phrases(model, [texts[i] for i in part])
        cost = counts * model.bits
        order = np.argsort(cost, axis=1, kind="stable")
        for i, c, o, k in zip(part, cost, order, counts):
            names[i] = model.languages[o[0]]
            scores[i] = float(1 - c[o[0]] / c[o[1]]) if len(o) > 1 else 1.0
            fits[i] = True
            if k[o[0]] > 8:
                expected = model.foreign[o[0]] * sum(map(str.isalpha, texts[i]))
                fits[i] = bool(k[o[0]] <= expected + 3 * math.sqrt(expected) + 1)
    return names, scores, fits


def _predicted(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` and text of each row with lang_pred, score and fits, through one broadcast model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, scores, fits = predict(shared.value, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in keep] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())],
                [*keep, "lang_pred", "score", "fits"])

    columns = list(dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("fits", "boolean")
    return mapped(docs.select(*columns), run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if
    no labelled row can be learned from. Equal costs go to the language first in order.
    Only text takes part in a prediction. A null doc_id is not held out. No rows: no rows.
    """
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("is_held_out"))
    got = _predicted(rows, ["doc_id", "is_held_out"], train(sample(docs)))
    return got.select("doc_id", F.col("is_held_out").alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has no letter or is of none of the learned languages; columns as they were.

    See predict() for when a text counts as foreign. Without a labelled row that can be
    learned from, no row stays. Extra columns may have any name.
    """
    text = docs.columns.index("text")
    plain = docs.toDF(*["text" if i == text else f"col_{i}" for i in range(len(docs.columns))])
    got = _predicted(plain, plain.columns, train(sample(docs)))
    return got.where("fits").select(*plain.columns).toDF(*docs.columns)
