"""Operator 5: best-fit packing by bin completion with branch and bound.

Documents become token ids (byte-level BPE) plus an end id; longer ones are cut
into full pieces, of which only the first may be shorter.  What must be packed
globally is then a histogram of at most ``capacity`` piece lengths, so the
search runs on counts on the driver, whatever the number of documents, and its
plan has a row per length and filling.  The incumbent is the better one of
best fit and bulk bin completion; small groups of its bins are then taken
apart and completed anew, which gathers the waste of many bins in one until it
is empty; a branch and bound on counts follows where the lower bound is still
missed.  Pieces find their place by their rank
within their length: a running count over (partition, length) plus the rank
that each piece got when it was written, so no group meets in one task.

Defined cases: null and empty texts give one piece with the end id alone;
repeated rows are separate pieces; an empty table gives no rows; rows with a
null ``doc_id`` are packed like others.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

CAPACITY = 1024
END_ID = 2
CACHE_ENTRIES = 400_000
#: What may be spent: nodes of one search, and steps inside fillings of all.
NODES = 20_000
STEPS = 1_000_000
#: Rounds of repacking, and the bins that take part.
REPACKS = 60_000
REPACK_BINS = 4096
IDLE = 10_000  # rounds without any gain that end it
# The pre-tokenizer pattern of the vocabulary's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ODD_SPACE = re.compile(r"\s\s|^\s|\s$")
_SEAM = re.compile(r"(?<=\S) (?=\S)")


class WordEncoder:
    """Ids of the vocabulary in a ``tokenizers`` file, as little-endian 32-bit bytes.

    A space between two characters that aren't white space always starts a new
    pre-token, so a text is encoded chunk by chunk and chunks are remembered
    (``CACHE_ENTRIES`` at most).  Added tokens of the file inside a text become
    their one id.  Ids equal those of ``tokenizers`` for the same file; tests
    hold them against it.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens with flags aren't supported")
        special = {t["content"]: t["id"] for t in added}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.ids = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if self.cut is None or self.cut.search(text) is None:
            return self._ordinary(text)
        return b"".join(self.added[part] if at % 2 else self._ordinary(part) for at, part in enumerate(self.cut.split(text)))

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ") if _ODD_SPACE.search(text) is None else _SEAM.split(text)
        cache, out = self.cache, [np.array(self.ids(head), "<u4").tobytes()]
        for chunk in rest:
            got = cache.get(chunk)
            if got is None:
                got = np.array(self.ids(" " + chunk), "<u4").tobytes()
                if len(chunk) < 40:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[chunk] = got
            out.append(got)
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _part, _rank): pieces with their rank among those of
    the same length in the same partition."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        encode, part = encoder(vocabulary).encode, TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            rows = []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, piece = 0, 0
                length = n - capacity * ((n - 1) // capacity)
                while start < n:
                    for to, value in zip(out, (piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, int(seen[length])), strict=True):
                        to.append(value)
                    rows.append(row)
                    seen[length] += 1
                    start, piece, length = start + length, piece + 1, capacity
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, t) for v, t in zip(out, types, strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, _part int, _rank long")


def completions(room: int, left: dict[int, int], nodes: int, least: int = 0, spent: list[int] | None = None):
    """Fillings of ``room`` from ``left`` (length -> count), fullest first among those found within ``nodes``.

    Depth first over lengths in falling order.  A filling is kept only if no
    unused piece still fits (such a filling is dominated), and the search stops
    at a filling without waste, as none can dominate it.  ``spent`` gathers the
    steps taken.
    """
    order = sorted((x for x in left if x <= room and left[x] > 0), reverse=True)
    found: dict[tuple, int] = {}
    budget = [nodes]

    def walk(at: int, space: int, taken: tuple, held: int | None) -> bool:
        """held: the largest length left out so far that would have fit."""
        budget[0] -= 1
        while at < len(order) and order[at] > space:
            at += 1
        if space == 0 or at == len(order):
            if held is None or held > space:  # else the left-out piece still fits: dominated
                found[taken] = space
                return space <= least
            return False
        if budget[0] < 0:
            return True
        x = order[at]
        most = min(left[x], space // x)
        for n in range(most, -1, -1):
            skipped = held if n == left[x] else x if held is None else min(held, x)
            if walk(at + 1, space - n * x, taken + ((x, n),) * bool(n), skipped):
                return True
            if budget[0] < 0:
                return True
        return False

    walk(0, room, (), None)
    if spent is not None:
        spent[0] += nodes - budget[0]
    return sorted(found, key=lambda f: (found[f], sum(n for _, n in f)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """The incumbent: best-fit decreasing over lengths; open bins are kept as (room, contents) with counts."""
    rooms: dict[int, list[list]] = {}  # room -> [[contents, how many]]
    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            fit = min((r for r in rooms if r >= x), default=None)
            if fit is None:
                each = min(capacity // x, left)
                many = left // each
                rooms.setdefault(capacity - each * x, []).append([((x, each),), many])
                left -= each * many
                continue
            have = rooms[fit].pop()
            if not rooms[fit]:
                del rooms[fit]
            contents, many = have
            each = min(fit // x, left)
            used = min(many, left // each)
            if used < many:
                rooms.setdefault(fit, []).append([contents, many - used])
            rooms.setdefault(fit - each * x, []).append([contents + ((x, each),), used])
            left -= each * used
    return [(tuple(c), m) for r in rooms.values() for c, m in r]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: bins of the pieces over half, and what smaller ones need beyond the room there."""
    lengths = np.array(sorted(k for k in counts if counts[k] > 0), np.int64)
    if not len(lengths):
        return 0
    many = np.array([counts[int(k)] for k in lengths], np.int64)
    best = 0
    for small in [0, *lengths[2 * lengths <= capacity].tolist()]:
        half, rest = (2 * lengths > capacity) & (lengths <= capacity - small), (2 * lengths <= capacity) & (lengths >= small)
        over = int((lengths * many)[rest | half].sum()) - int(many[half].sum()) * capacity
        best = max(best, int(many[2 * lengths > capacity].sum()) + max(0, -(-over // capacity)))
    return best


def branch_and_bound(counts: dict[int, int], capacity: int, best: list[tuple[tuple, int]], least: int) -> list[tuple[tuple, int]]:
    """A better solution than ``best`` if one is found, by branching on counts.

    A branch is a filling around the largest piece and how many bins have it
    (as many as can be, half of that, ..., one; more come from branching
    again).  It ends where it wastes more than the wanted number of bins can.
    The wanted number starts at ``least`` and is relaxed.  What is left is not
    searched twice.  A search spends NODES nodes at most and all searches STEPS
    steps inside fillings, however many pieces there are.
    """
    total, size = sum(k * v for k, v in counts.items()), sum(m for _, m in best)
    spent, known = [0], {}

    def options(left: dict[int, int]):
        x = max(left)
        rest = {k: v - (k == x) for k, v in left.items() if v - (k == x)}
        key = (x, *((k, min(v, capacity // k + 1)) for k, v in rest.items()))  # more of a length makes no difference
        if key not in known:
            known[key] = completions(capacity - x, rest, 2000, least=-1, spent=spent) or [()]
        for fill in known[key]:
            used = dict(fill)
            empty = capacity - x - sum(k * n for k, n in fill)
            used[x] = used.get(x, 0) + 1
            many = min(left[k] // n for k, n in used.items())
            while many:
                yield tuple(sorted(used.items(), reverse=True)), many, empty
                many //= 2

    wanted, gap, steps = least, 1, STEPS
    while wanted < size and steps > 1000:
        steps //= 2
        nodes, spent[0] = NODES, 0
        known.clear()
        seen: dict[frozenset, int] = {}  # what was left at a node, with the bins before it
        path: list[tuple[tuple, int]] = []
        stack = [(counts, 0, 0, options(counts))]
        while stack and nodes > 0 and spent[0] < steps and wanted < size:
            left, bins, waste, todo = stack[-1]
            option = next(todo, None)
            if option is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            fill, many, empty = option
            if waste + many * empty > min(wanted, size - 1) * capacity - total:
                continue
            nodes -= 1
            used = dict(fill)
            after = {k: v - many * used.get(k, 0) for k, v in left.items() if v > many * used.get(k, 0)}
            state = frozenset(after.items())
            if seen.get(state, size) <= bins + many:
                continue
            seen[state] = bins + many
            path.append((fill, many))
            if after:
                stack.append((after, bins + many, waste + many * empty, options(after)))
                continue
            best, size = list(path), bins + many
            path.pop()
        wanted, gap = min(wanted + gap, max(size - 1, wanted + 1)), 2 * gap
    return best


def _fullest(pieces: list[int], room: int) -> list[int]:
    """Places in ``pieces`` of a filling of ``room`` that has the least waste, of early pieces where it can."""
    reach, mask = [1] * (len(pieces) + 1), (1 << (room + 1)) - 1
    for k in range(len(pieces) - 1, -1, -1):  # sums of the pieces from k on, a bit each
        reach[k] = reach[k + 1] | (reach[k + 1] << pieces[k]) & mask
    left, taken = reach[0].bit_length() - 1, []
    for k, x in enumerate(pieces):
        if left >= x and reach[k + 1] >> (left - x) & 1:
            taken.append(k)
            left -= x
    return taken


def repacked(best: list[tuple[tuple, int]], capacity: int, least: int, rounds: int = REPACKS) -> list[tuple[tuple, int]]:
    """``best`` after ``rounds`` times taking a few of its bins apart and completing them anew around the largest piece.

    The new bins stay if they are fewer, or as many with the waste less evenly
    spread.  All bins with waste take part, or REPACK_BINS of them with the
    most waste; the choice is the same on every run.
    """
    size = sum(m for _, m in best)
    order = sorted((capacity - sum(x * n for x, n in fill), fill, many) for fill, many in best)
    bins: list[list[int]] = []
    rest: list[tuple[tuple, int]] = []
    for waste, fill, many in reversed(order):
        take = min(many, REPACK_BINS - len(bins)) if fill[0][0] < capacity else 0
        bins += [[x for x, n in fill for _ in range(n)] for _ in range(take)]
        if many > take:
            rest.append((fill, many - take))
    rng, better = np.random.default_rng(len(bins)), 0
    for step in range(rounds):
        if size <= least or len(bins) < 2 or step - better > IDLE:
            break
        chosen = set(rng.integers(0, len(bins), int(rng.integers(2, 20))).tolist())
        if step % 50 == 0:
            chosen.add(min(range(len(bins)), key=lambda k: sum(bins[k])))
        pool, made = sorted((x for k in chosen for x in bins[k]), reverse=True), []
        while pool:
            largest = pool.pop(0)
            got = set(_fullest(pool, capacity - largest))
            made.append([largest, *(x for k, x in enumerate(pool) if k in got)])
            pool = [x for k, x in enumerate(pool) if k not in got]
        squares = sum(sum(b) ** 2 for b in made) - sum(sum(bins[k]) ** 2 for k in chosen)
        if len(made) < len(chosen) or len(made) == len(chosen) and squares >= 0:
            better = step if squares > 0 else better
            size -= len(chosen) - len(made)
            places = sorted(chosen)
            for k, b in zip(places, made, strict=False):
                bins[k] = b
            for k in reversed(places[len(made) :]):
                bins[k] = bins[-1]
                bins.pop()
    fills: dict[tuple, int] = {}
    for b in bins:
        fill = tuple((x, b.count(x)) for x in sorted(set(b), reverse=True))
        fills[fill] = fills.get(fill, 0) + 1
    return [*rest, *fills.items()]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Fillings ((length, how often), ...) with the number of bins that use each.

    Bin completion around the largest piece, in bulk: a filling is used as
    often as the counts allow, so there are about as many steps as lengths.
    Where that and the best-fit solution have more bins than the lower bound,
    the better one is repacked and becomes the incumbent of a branch and bound.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size = sum(m for _, m in best)
    if size > least:
        left, bulk = dict(counts), []
        while left:
            x = max(left)
            left[x] -= 1
            found = completions(capacity - x, left, 3000)
            left[x] += 1
            fill = dict(found[0]) if found else {}
            fill[x] = fill.get(x, 0) + 1
            many = min(left[k] // n for k, n in fill.items())
            bulk.append((tuple(sorted(fill.items(), reverse=True)), many))
            for k, n in fill.items():
                left[k] -= n * many
                if not left[k]:
                    del left[k]
        if sum(m for _, m in bulk) < size:
            best, size = bulk, sum(m for _, m in bulk)
        if size > least:
            best = repacked(best, capacity, least)
            size = sum(m for _, m in best)
    return branch_and_bound(counts, capacity, best, least) if size > least else best


def place_plan(fillings: list[tuple[tuple, int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, pieces of this length a bin, offset of the first), by rank."""
    plan: dict[int, list] = {}
    given: dict[int, int] = {}
    first = 0
    for fill, many in fillings:
        offset = 0
        for x, n in fill:
            plan.setdefault(x, []).append((given.get(x, 0), first, n, offset))
            given[x] = given.get(x, 0) + n * many
            offset += x * n
        first += many
    return {x: np.array(rows, np.int64) for x, rows in plan.items()}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, vocabulary, capacity), "pieces")
    per_part = cut.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(per_part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "piece_counts")
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    plan = place_plan(pack_counts(counts, capacity))
    kind = docs.schema["doc_id"].dataType

    def place(batches):
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), (pdf["_before"] + pdf["_rank"]).to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rows = plan[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                bin_, slot = np.divmod(rank[at] - row[:, 0], row[:, 2])
                sequence[at], offset[at] = row[:, 1] + bin_, row[:, 3] + slot * x
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    joined = cut.join(starts.select("_part", "length", "_before"), ["_part", "length"])
    return joined.mapInPandas(place, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
