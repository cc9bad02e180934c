"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds the 64-bit hashes of its distinct ``width``-word shingles.  Two
documents link when 100 * intersection >= percent * union.  Equal sets are one node, so
copies never meet each other in a join.

- Small sets (up to a boundary size) enumerate subsets of the one size that a link of
  two sets of these sizes requires, ceil(percent * (n + m) / (100 + percent)); two sets
  that share such a subset are linked, with nothing left to check, and a subset's sets
  are joined as a star.
- Larger sets scan inverted lists, of the shingles that every link has in common: in one
  order of all shingles, the first n - ceil(percent * n / 100) + 1 of each set.  The
  order puts shingles that tasks have seen often last (it matters for speed only; any
  order is exact).  A list first checks its members against one of them, its leader, so a
  group of near copies costs its size and not its square; lists of the same members count
  once.  Only members of one list that then lie in different components are compared, by
  blocks of ``BLOCK`` members, two of which a task compares by their sketches.  Where these
  leave more pairs than members, a task gets the members' sets and links them by a tree.
- The boundary is the size with the least cost: subsets enumerated against list entries
  and their expected checks, from the sizes of all sets.

A pair is checked in two steps: the parity sketches of its sets bound the symmetric
difference from below, which drops nearly all pairs that are not linked, and then the
sets are intersected.  Links become components by alternating large and small stars.

Empty and null texts have no shingle and link with nothing.  Texts with fewer words than
``width`` have one shingle, all of their words.  Null ids take part by their text; the
component id is the smallest id there is.  Rows with the same id stay rows of their own.
Nodes are 64-bit hashes of sets: in 10**9 different texts, two share one with a chance
of about 3 %.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WORD, arrow_rows, claim, materialize

WIDTH, PERCENT = 4, 85
#: Largest size that may enumerate subsets.
MOST_SMALL = 20
SHORT_LIST, BLOCK = 256, 256
#: What is left of lists up to this size is paired by a join.
TINY = 16
#: A shingle counts as frequent when tasks saw it LOCAL times each and OFTEN times together;
#: the most frequent ones go to all tasks, and those of HOT and more are cut into blocks at once.
LOCAL, OFTEN, MOST_FREQUENT, HOT = 3, 8, 1_000_000, 4_096
#: A sketch has the power of two from the size of its set on for bits, between these.
LEAST_SKETCH, MOST_SKETCH = 128, 16_384
#: Candidates are found again among the documents by a bitmap of so many bits each, at least and at most these in all.
CANDIDATE_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 31
COUNTED_TOKENS = 2_000_000
#: Shingles of the sets that a task intersects with each other or with as many others (a larger set is alone).
LOT = 1_000_000
#: Rows of an Arrow batch, which hold whole texts or sets.
ARROW_ROWS = 1_000
#: Bytes of texts hashed at a time (a longer text is one piece of its own), and the longest word hashed with others.
PIECE, LONG_WORD = 1 << 18, 4_096


def _phase(name: str) -> None:
    """At the start of a task: the worker gives back the memory that it held for other phases."""
    claim(f"jaccard {name}")
    pa.default_memory_pool().release_unused()


def text_key():
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _mixed(h):
    """64-bit values with every bit spread over all bits (arrays of uint64, wrapping)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


@cache
def _weights():
    """A value per byte (none for white space, the same for A and a) and a weight per place in a word."""
    import numpy as np

    value = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    value[space] = 0
    return space, value, _mixed(np.arange(1_000, 1_000 + LONG_WORD, dtype=np.uint64)) | np.uint64(1)


def hashed_words(data, offsets):
    """Hashes of the words of texts that lie end to end in data (uint8), and each text's first word (and the end).

    A word's hash is the sum of its bytes' values times their places' weights, so all words of
    many texts are hashed by a few array operations.
    """
    import numpy as np

    space, value, weight = _weights()
    inside = ~space[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    at = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    begins[at], ends[at - 1] = inside[at], inside[at - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.zeros(len(begins), np.uint64)
    first = 0
    while first < len(begins):
        last = max(first + 1, int(np.searchsorted(ends, begins[first] + PIECE)))
        start, own = begins[first], begins[first:last] - begins[first]
        if last == first + 1 and ends[first] - start > LONG_WORD:
            word = data[start : ends[first]].tobytes().lower()
            out[first] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        else:
            size = int(ends[last - 1] - start)
            place = np.arange(size) - np.repeat(own, np.diff(np.append(own, size)))
            out[first:last] = np.add.reduceat(value[data[start : start + size]] * weight[np.minimum(place, LONG_WORD - 1)], own)
            for k in (np.flatnonzero(ends[first:last] - begins[first:last] > LONG_WORD) + first).tolist():
                out[k] = int.from_bytes(blake2b(data[begins[k] : ends[k]].tobytes().lower(), digest_size=8).digest(), "little")
        first = last
    return _mixed(out), np.searchsorted(begins, offsets)


def _shingled(words, width: int):
    """Hash of every run of width words."""
    import numpy as np

    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ words[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def shingle_sets(column: pa.Array, width: int = WIDTH):
    """Each text's sorted distinct hashes of its shingles, as int64; about PIECE bytes of texts at a time."""
    import numpy as np

    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = min(len(column), max(row + 1, int(np.searchsorted(ends, ends[row] + PIECE, "right")) - 1))
        words, cuts = hashed_words(data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        every = _shingled(words, width) if len(words) >= width else words[:0].astype(np.int64)
        for a, b in itertools.pairwise(cuts.tolist()):
            own = np.sort(every[a : b - width + 1] if b - a >= width else _shingled(words[a:b], b - a)) if b > a else every[:0]
            yield own if len(own) < 2 else own[np.concatenate([[True], own[1:] != own[:-1]])]
        row = stop


def node_of(s) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_keys(s, boundary: int, percent: int):
    """(other size, key) of the subsets that a small set shares with its links of each size."""
    import numpy as np

    n = len(s)
    for m in range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1):
        c = least_overlap(n, m, percent)
        if c > min(n, m) or m < 1:
            continue
        mixed = s.astype(np.uint64)
        with np.errstate(over="ignore"):
            total = mixed.sum(dtype=np.uint64) + np.uint64(0x100000001B3) * np.uint64(min(n, m) * 1000 + max(n, m))
            # a subset is what remains when n - c elements go
            gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
            keys = total - mixed[gone].sum(axis=1, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        yield m, keys.astype(np.int64)


def boundary_by_cost(sizes: dict[int, int], percent: int, checks: float = 40.0) -> int:
    """Largest size to enumerate subsets for; sizes: sets by size, those up to MOST_SMALL matter."""

    def subsets(n: int, b: int) -> int:
        return sum(comb(n, least_overlap(n, m, percent)) for m in range(-(-percent * n // 100), min(b, 100 * n // percent) + 1) if least_overlap(n, m, percent) <= min(n, m))

    def cost(b: int) -> float:
        light = sum(k * subsets(n, b) for n, k in sizes.items() if n <= b)
        heavy = sum(k * prefix_length(n, percent) * (1 + checks * (n > b)) for n, k in sizes.items() if 100 * n >= percent * (b + 1))
        return light + heavy

    return min(range(MOST_SMALL + 1), key=cost)


def _rows(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.nulls(v, kinds[t]) if isinstance(v, int) else v if isinstance(v, pa.Array) else pa.array(v, kinds[t]) for v, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


SETS = "doc_id long, text_key string, node long, n int, token long, c long"


def _sets(width: int):
    """A row per document, and (token, c) of shingles seen LOCAL times in one task's distinct sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _phase("sets")
        held, size, seen = np.empty(COUNTED_TOKENS, np.int64), 0, set()

        def frequent(own):
            own.sort()  # in place: the buffer is all that a task holds
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            c = np.diff(np.append(starts, len(own)))
            token, c = own[starts[c >= LOCAL]], c[c >= LOCAL]
            k = len(token)
            return _rows(SETS, [k, k, k, k, token, c])

        for batch in batches:
            nodes, counts = [], []
            for s in shingle_sets(batch.column(2), width):
                nodes.append(node := node_of(s))
                counts.append(len(s))
                if node not in seen and len(s):
                    if size and size + len(s) > COUNTED_TOKENS:
                        yield frequent(held[:size])
                        size, seen = 0, set()
                    seen.add(node)
                    if len(s) > len(held):
                        held = np.empty(len(s), np.int64)
                    held[size : size + len(s)] = s
                    size += len(s)
            yield _rows(SETS, [batch.column(0), batch.column(1), nodes, counts, len(nodes), len(nodes)])
        if size:
            yield frequent(held[:size])

    return run


ENTRIES = "kind int, key long, node long, n int, m int"
SUBSET, LIST, HOT_LIST = 0, 1, 2


def _entries(shared, boundary: int, width: int, percent: int):
    """Subset keys of small sets (m: other size), list entries of others (m: block of a hot list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _phase("entries")
        often, counts = shared.value
        seen: set[int] = set()
        out, size = [], 0

        def flush():
            lengths = [len(x[1]) for x in out]
            kind, node, n = (np.repeat([x[k] for x in out], lengths) for k in (0, 2, 3))
            return _rows(ENTRIES, [kind.astype(np.int32), np.concatenate([x[1] for x in out]), node, n.astype(np.int32), np.concatenate([x[4] for x in out]).astype(np.int32)])

        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                n, node = len(s), node_of(s)
                if not n or node in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                if n <= boundary:
                    for m, keys in subset_keys(s, boundary, percent):
                        out.append((SUBSET, keys, node, n, np.full(len(keys), m)))
                        size += len(keys)
                if 100 * n >= percent * (boundary + 1):
                    take = prefix_length(n, percent)
                    c = np.zeros(n, np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        c = np.where(often[at] == s, counts[at], 0)
                    rare = c == 0
                    if np.count_nonzero(rare) >= take:
                        s, c = s[rare][:take], c[rare][:take]
                    else:
                        order = np.lexsort((s, c))[:take]
                        s, c = s[order], c[order]
                    hot = c >= HOT
                    if (~hot).any():
                        out.append((LIST, s[~hot], node, n, np.zeros(int((~hot).sum()), np.int64)))
                    if hot.any():
                        out.append((HOT_LIST, s[hot], node, n, (node & 0x7FFFFFFF) % -(-c[hot] // BLOCK)))
                    size += take
                if size >= 100_000:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return run


MEETINGS = "kind int, a long, b long, key long, n int, m int"
#: A leader (a) with another member (b) of a short list; members (a) of short lists by what they hold; members of long lists.
PAIR, MEMBER, LONG = 3, 4, 5


class _Lists:
    """Turns sorted inverted lists into meetings; a list longer than a buffer is handed on as it comes."""

    def __init__(self, boundary: int, percent: int):
        self.boundary, self.percent = boundary, percent
        self.going = None
        self.pairs_held: list = []
        self.members_held: list = []
        self.held = 0
        self.known: set[int] = set()

    def long(self, key: int, node, n) -> pa.RecordBatch:
        self.going = key
        return _meeting(LONG, a=node, key=key, n=n)

    def whole(self, key, node, n) -> Iterator[pa.RecordBatch]:
        """Lists that end here; the first may be the one that is going."""
        import numpy as np

        first = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node, n = key[first], node[first], n[first]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        if self.going is not None and key[0] == self.going:
            yield self.long(self.going, node[: ends[0]], n[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        self.going = None
        more = ends - starts > 1
        for a, b in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            if b - a > SHORT_LIST:
                yield self.long(key[a], node[a:b], n[a:b])
                self.going = None
                continue
            order = np.argsort(node[a:b])
            own, size = node[a:b][order], n[a:b][order]
            holds = hash(own.tobytes())
            if holds in self.known:
                continue
            if len(self.known) >= 100_000:
                self.known.clear()
            self.known.add(holds)
            self.pairs_held.append((np.full(b - a - 1, own[0]), own[1:], np.full(b - a - 1, size[0]), size[1:]))
            self.held += b - a
            if b - a > 2:  # equal lists have one key, in any task
                self.members_held.append((np.full(b - a, node_of(own)), own, size))
            if self.held >= 50_000:
                yield from self.flush()
        return

    def flush(self) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if self.pairs_held:
            a, b, n, m = (np.concatenate(c) for c in zip(*self.pairs_held, strict=True))
            ok = may_link(n, m, self.boundary, self.percent)
            both = np.unique(np.stack([a[ok], b[ok]]), axis=1)
            yield _meeting(PAIR, a=both[0], b=both[1])
        if self.members_held:
            key, node, n = (np.concatenate(c) for c in zip(*self.members_held, strict=True))
            yield _meeting(MEMBER, a=node, key=key, n=n)
        self.pairs_held, self.members_held, self.held = [], [], 0


def may_link(n, m, boundary: int, percent: int):
    """Sizes that allow a link, one of them beyond those that subsets settle."""
    import numpy as np

    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.maximum(n, m) > boundary)


def _meeting(kind: int, **columns) -> pa.RecordBatch:
    """A batch of MEETINGS; single values are repeated, columns not named are null."""
    import numpy as np

    k = len(columns["a"])
    names = [c.split()[0] for c in MEETINGS.split(", ")]
    full = {"kind": kind} | columns
    return _rows(MEETINGS, [np.broadcast_to(np.asarray(full[c], np.int32 if c in ("kind", "n", "m") else np.int64), k).copy() if c in full else k for c in names])


def _meetings(boundary: int, percent: int):
    """From entries in order of (kind, key, n, node): subset keys that two sets share, leaders' pairs and
    members of short lists, members of long ones; entries of hot lists are members already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _phase("meetings")
        lists = _Lists(boundary, percent)

        def subsets(key, node, n, m, more=False):
            """Rows whose key has more than one set; more: the only key goes on."""
            first = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(first) - 1
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            keep = (np.bincount(group, fresh)[group] > 1) | more
            if keep.any():
                yield _meeting(SUBSET, a=node[keep], key=key[keep], n=n[keep], m=m[keep])

        none = np.zeros(0, np.int64)
        left, long_subset = (none,) * 5, None
        for batch in batches:
            kind, key, node, n, m = (np.concatenate([x, batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate(left))
            hot = kind == HOT_LIST
            if hot.any():
                yield _meeting(LONG, a=node[hot], key=key[hot], n=n[hot])
                kind, key, node, n, m = (x[~hot] for x in (kind, key, node, n, m))
            if not len(key):
                left = (none,) * 5
                continue
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]))
            cut = int(start[-1])
            for want in (SUBSET, LIST):
                own = np.flatnonzero(kind[:cut] == want)
                if not len(own):
                    continue
                part = slice(int(own[0]), int(own[-1]) + 1)
                if want == SUBSET:
                    goes_on = key[part] == long_subset if long_subset is not None else np.zeros(len(own), bool)
                    if goes_on.any():
                        yield from subsets(key[part][goes_on], node[part][goes_on], n[part][goes_on], m[part][goes_on], more=True)
                    if not goes_on.all():
                        yield from subsets(*(x[part][~goes_on] for x in (key, node, n, m)))
                    long_subset = None
                else:
                    yield from lists.whole(key[part], node[part], n[part])
            left = tuple(x[cut:] for x in (kind, key, node, n, m))
            if len(left[0]) > 4 * SHORT_LIST:
                if left[0][0] == SUBSET:
                    yield from subsets(*left[1:], more=True)
                    long_subset = left[1][0]
                else:
                    fresh = np.concatenate([[True], left[2][1:] != left[2][:-1]])
                    yield lists.long(key[-1], left[2][fresh], left[3][fresh])
                left = (none,) * 5
        kind, key, node, n, m = left
        if len(key) and kind[0] == SUBSET:
            yield from subsets(key, node, n, m, more=key[0] == long_subset)
        elif len(key):
            yield from lists.whole(key, node, n)
        yield from lists.flush()

    return run


CANDIDATES = "node long, n int, sketch binary, elements binary"


def sketch_bits(n: int) -> int:
    return max(LEAST_SKETCH, min(MOST_SKETCH, 1 << max(0, (n - 1).bit_length())))


def sketch_of(s):
    """Parity of the set's elements in sketch_bits cells; a wide sketch folds into a narrower one."""
    import numpy as np

    bits = sketch_bits(len(s))
    cell = (s.astype(np.uint64) >> np.uint64(17)).astype(np.int64) % bits
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8))


def folded(sketches, width: int):
    """Sketches (rows of uint64) of width words each."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


class _Sketches:
    """Sketches of many sets, each as wide as its set asks for."""

    def __init__(self, sketches: list[bytes]):
        import numpy as np

        words = np.array([len(x) // 8 for x in sketches], np.int64)
        self.words, self.place, self.by = words, np.zeros(len(words), np.int64), {}
        for width in np.unique(words).tolist():
            at = np.flatnonzero(words == width)
            self.place[at] = np.arange(len(at))
            self.by[width] = np.frombuffer(b"".join([sketches[k] for k in at.tolist()]), np.uint64).reshape(len(at), width)

    def differences(self, i, other: "_Sketches", j):
        """Differing bits of sketches i here and j there (arrays of the same length), in the narrower one's width."""
        import numpy as np

        out = np.zeros(len(j), np.int64)
        pairs = self.words[i] * (1 << 32) + other.words[j]
        for both in np.unique(pairs).tolist():
            at = np.flatnonzero(pairs == both)
            wide, narrow = both >> 32, both & 0xFFFFFFFF
            width = min(wide, narrow)
            x, y = self.by[wide][self.place[i[at]]], other.by[narrow][other.place[j[at]]]
            out[at] = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum(axis=1)
        return out


def most_difference(n, m, percent: int):
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (n + m) // (100 + percent)


def _candidates(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _phase("candidates")
        bitmap, seen, out = shared.value, set(), []
        cells = 8 * len(bitmap) - 1
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                node = node_of(s)
                cell = node & cells
                if not len(s) or node in seen or not bitmap[cell >> 3] >> (cell & 7) & 1:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(node)
                out.append((node, len(s), sketch_of(s).tobytes(), s.astype("<i8").tobytes()))
                if len(out) >= 500:
                    yield _rows(CANDIDATES, list(zip(*out, strict=True)))
                    out = []
        if out:
            yield _rows(CANDIDATES, list(zip(*out, strict=True)))

    return run


def _bitmap(nodes: DataFrame):
    """Broadcast bitmap of the nodes' low bits, sized by their number; it may let others through, but loses none."""
    import numpy as np

    count = nodes.agg(F.approx_count_distinct("node")).first()[0]
    bits = LEAST_BITS
    while bits < min(MOST_BITS, CANDIDATE_BITS * count):
        bits *= 2
    piece = 1 << 16

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cell = np.unique(batch.column(0).to_numpy())
            for at, own in zip(*_runs(cell >> 16, cell & (piece - 1)), strict=True):
                held.setdefault(at, np.zeros(piece, np.uint8))[own] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in held.values()], pa.binary())], names=["at", "bits"])

    cells = nodes.select(F.col("node").bitwiseAND(F.lit(bits - 1)).alias("cell"))
    out = np.zeros(bits // 8, np.uint8)
    # the pieces meet in their task, so the driver gets each once: the bitmap's own size
    found = cells.withColumn("at", F.shiftright("cell", 16)).repartition("at").select("cell").mapInArrow(pieces, "at long, bits binary")
    for row in found.toLocalIterator():
        at = row["at"] * (piece // 8)
        out[at : at + piece // 8] |= np.frombuffer(row["bits"], np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(out.tobytes())


def _runs(key, value):
    """Distinct values of a sorted key, and the values of each."""
    import numpy as np

    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[cuts].tolist(), np.split(value, cuts[1:]) if len(key) else []


def linked(a, b, percent: int) -> bool:
    import numpy as np

    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _near_sketches(percent: int):
    """Keeps pairs (a, b, n, m, sketch, sketch) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _phase("sketches")
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            x, y = (_Sketches(batch.column(k).to_pylist()) for k in (4, 5))
            every = np.arange(batch.num_rows)
            ok = x.differences(every, y, every) <= most_difference(n, m, percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])

    return run


def _checked(percent: int):
    """Keeps pairs (a, b, elements, elements) whose sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _phase("checks")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
                ok = pa.array([linked(np.frombuffer(s, "<i8"), np.frombuffer(t, "<i8"), percent) for s, t in zip(x, y, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(ok) for k in (0, 1)], names=["a", "b"])

    return run


def _join_blocks(percent: int, boundary: int):
    """Of the pairs of a block that are apart and that sizes and sketches allow, those that a tree of them needs."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.drop_duplicates("node")
        node, n = pdf["node"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
        tree = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
        sketch = _Sketches(pdf["sketch"].tolist())
        out = [np.zeros((0, 2), np.int64)]
        for i in range(len(pdf) - 1):
            j = np.flatnonzero(may_link(n[i], n[i + 1 :], boundary, percent) & (tree[i] != tree[i + 1 :])) + i + 1
            j = j[sketch.differences(np.full(len(j), i), sketch, j) <= most_difference(n[i], n[j], percent)]
            if len(j):
                met, first = np.unique(tree[j], return_index=True)
                out.append(np.stack([np.minimum(node[i], node[j[first]]), np.maximum(node[i], node[j[first]])], axis=1))
                tree[np.isin(tree, met)] = tree[i]
        return pd.DataFrame(np.concatenate(out), columns=["a", "b"]).astype("int64")

    return run


NEAR = "key long, p int, q int, lots long, block int, node long, n int, root long, other long"


def _compare_blocks(percent: int, boundary: int):
    """What is left between (or within) the two blocks of a group of pairs that are apart and that sizes and sketches allow.

    A row per pair (node, other) where these are no more than their members, else a row per member
    and pair of lots in which it has to be intersected: a group never gives the square of its size.
    """

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.drop_duplicates("node")
        node, n, block, root = (pdf[c].to_numpy() for c in ("node", "n", "block", "root"))
        n = n.astype(np.int64)
        sketch = _Sketches(pdf["sketch"].tolist())
        left, right = [], []
        for i in range(len(pdf)):
            j = np.flatnonzero(may_link(n[i], n[i + 1 :], boundary, percent) & (root[i] != root[i + 1 :]) & ((block[i] != block[i + 1 :]) | (key[1] == key[2]))) + i + 1
            right.append(j[sketch.differences(np.full(len(j), i), sketch, j) <= most_difference(n[i], n[j], percent)])
            left.append(np.full(len(right[-1]), i))
        left, right = np.concatenate(left), np.concatenate(right)
        met = np.unique(np.concatenate([left, right]))
        if len(left) <= len(met):
            member, lots, other = left, np.zeros(len(left), np.int64), pd.array(node[right], "Int64")
        else:
            lot = np.zeros(len(pdf), np.int64)
            lot[met] = np.cumsum(n[met]) // LOT
            both = np.minimum(lot[left], lot[right]) << 32 | np.maximum(lot[left], lot[right])
            lots, member = np.unique(np.stack([np.tile(both, 2), np.concatenate([left, right])]), axis=1)
            other = pd.array([None] * len(member), "Int64")
        own = {c: np.full(len(member), v, np.int64) for c, v in zip(("key", "p", "q"), key, strict=True)}
        return pd.DataFrame(own | {"lots": lots, "block": block[member], "node": node[member], "n": n[member], "root": root[member], "other": other})

    return run


def _link_blocks(percent: int, boundary: int):
    """Links of the members of two lots that are apart, checked by their sets: those that a tree of them needs."""

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        node, n, block = (pdf[c].to_numpy() for c in ("node", "n", "block"))
        n = n.astype(np.int64)
        tree = np.unique(pdf["root"].to_numpy(), return_inverse=True)[1]
        sets = [np.frombuffer(x, "<i8") for x in pdf["elements"]]
        sketch = _Sketches([sketch_of(x).tobytes() for x in sets])
        out = []
        for i in range(len(pdf) - 1):
            j = np.flatnonzero(may_link(n[i], n[i + 1 :], boundary, percent) & (tree[i] != tree[i + 1 :]) & ((block[i] != block[i + 1 :]) | (key[1] == key[2]))) + i + 1
            j = j[sketch.differences(np.full(len(j), i), sketch, j) <= most_difference(n[i], n[j], percent)]
            for k in j.tolist():
                if tree[k] != tree[i] and linked(sets[i], sets[k], percent):
                    out.append((min(node[i], node[k]), max(node[i], node[k])))
                    tree[tree == tree[k]] = tree[i]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes in links (a, b): root is the smallest node that links reach."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u")
        small = small.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v"))).distinct()
        edges = materialize(small, "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) % 1000003"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _links(texts: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes that join all that are linked; not every link of a group is listed."""
    import numpy as np

    context = texts.sparkSession.sparkContext
    found = sets.filter("token IS NOT NULL").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN).orderBy(F.col("c").desc(), "token").limit(MOST_FREQUENT).toArrow()
    token, c = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(token)
    often = context.broadcast((token[order], c[order]))
    nodes = sets.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"))
    sizes = {r["n"]: r["k"] for r in nodes.filter(F.col("n") <= 2 * MOST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    boundary = boundary_by_cost(sizes, percent)

    entries = texts.mapInArrow(_entries(often, boundary, width, percent), ENTRIES)
    # kind, m and n travel as one number: there are more of these rows than of any others
    packed = F.shiftleft(F.col("kind").cast("long"), 61).bitwiseOR(F.shiftleft(F.col("m").cast("long"), 31)).bitwiseOR(F.col("n").cast("long"))
    kind, m, n = F.shiftright("size", 61), F.shiftright("size", 31).bitwiseAND(F.lit((1 << 30) - 1)), F.col("size").bitwiseAND(F.lit((1 << 31) - 1))
    # the lists of one key meet in a task; hot ones are dealt by their blocks, as they need not meet
    dealt = entries.select("key", "node", packed.alias("size")).repartition("key", F.when(kind == HOT_LIST, m).otherwise(0))
    dealt = dealt.select(*[x.cast("int").alias(c) for c, x in (("kind", kind), ("n", n), ("m", m))], "key", "node").sortWithinPartitions("kind", "key", "n", "node")
    met = materialize(dealt.select("kind", "key", "node", "n", "m").mapInArrow(_meetings(boundary, percent), MEETINGS), "shingle-meetings")

    # small sets: the sets of one size under a key all link to those of the other size
    lo, hi = F.least("n", "m"), F.greatest("n", "m")
    keyed = met.filter(F.col("kind") == SUBSET).select("key", lo.alias("lo"), hi.alias("hi"), F.col("a").alias("node"), "n")
    ends = keyed.groupBy("key", "lo", "hi").agg(F.min(F.expr("CASE WHEN n = lo THEN node END")).alias("first"), F.min(F.expr("CASE WHEN n = hi THEN node END")).alias("last"))
    ends = ends.filter("first IS NOT NULL AND last IS NOT NULL")
    stars = keyed.join(ends, ["key", "lo", "hi"]).select(F.col("node").alias("a"), F.expr("CASE WHEN n = lo THEN last ELSE first END").alias("b")).filter("a <> b").distinct()

    long = met.filter(F.col("kind") == LONG).select("key", F.col("a").alias("node"), "n").distinct()
    leaders = long.groupBy("key").agg(F.min(F.struct("node", "n")).alias("x")).select("key", F.col("x.node").alias("a"), F.col("x.n").alias("m"))
    size_ok = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.greatest("n", "m") > boundary)
    led = long.join(leaders, "key").filter(F.col("a") != F.col("node")).filter(size_ok).select("a", F.col("node").alias("b"))
    pairs = met.filter(F.col("kind") == PAIR).select("a", "b").unionByName(led).distinct()
    members = met.filter(F.col("kind") == MEMBER).select("key", F.col("a").alias("node"), "n").distinct().withColumn("long", F.lit(False))
    members = members.unionByName(long.withColumn("long", F.lit(True)))

    bitmap = _bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")))
    own = materialize(texts.mapInArrow(_candidates(bitmap, width), CANDIDATES), "candidate-sets")
    brief = own.select("node", "n", "sketch").dropDuplicates(["node"])

    def checked(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b)."""
        left, right = (brief.toDF(x, f"{x}_n", f"{x}_sketch") for x in "ab")
        near = pairs.join(left, "a").join(right, "b").select("a", "b", "a_n", "b_n", "a_sketch", "b_sketch").mapInArrow(_near_sketches(percent), "a long, b long")
        return exact(materialize(near, "near-pairs"))

    def exact(near: DataFrame) -> DataFrame:
        # of the candidates' sets, only those still in question move; a set comes from several tasks if it has copies
        asked = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = own.select("node", "elements").join(asked, "node", "left_semi").dropDuplicates(["node"])
        left, right = (sets.select(F.col("node").alias(x), F.col("elements").alias(f"{x}_set")) for x in "ab")
        return materialize(near.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(_checked(percent), "a long, b long"), "checked-links")

    def apart(links: DataFrame) -> DataFrame:
        """Members of the lists that hold more than one component, with their roots."""
        rooted = members.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("key", "size")
        return materialize(rooted.join(split, "key"), "split-lists")

    blocks = F.ceil(F.col("size") / BLOCK).cast("int")

    def blocked(rest: DataFrame) -> DataFrame:
        long = rest.filter(F.col("size") > TINY).withColumn("blocks", blocks).withColumn("block", F.pmod("node", "blocks").cast("int"))
        return long.join(brief.select("node", "sketch"), "node")

    links = stars.unionByName(checked(pairs))
    # a tree in every block first: a group of near copies then is one component before any two blocks meet
    tree = blocked(apart(links)).select("key", "block", "node", "n", "root", "sketch")
    tree = materialize(tree.groupBy("key", "block").applyInPandas(_join_blocks(percent, boundary), "a long, b long").distinct(), "near-pairs")
    links = links.unionByName(exact(tree))
    rest = apart(links)
    short = rest.filter(F.col("size") <= TINY)
    left, right = short.select("key", F.col("node").alias("a"), "n", F.col("root").alias("a_root")), short.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("root").alias("b_root"))
    last = left.join(right, "key").filter("a < b AND a_root <> b_root").filter(size_ok).select("a", "b").distinct()
    spread = blocked(rest).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "n", "root", "sketch")
    near = materialize(spread.groupBy("key", "p", "q").applyInPandas(_compare_blocks(percent, boundary), NEAR), "near-members")
    few = materialize(near.filter("other IS NOT NULL").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "near-pairs")
    many = near.filter("other IS NULL").drop("other")
    asked = own.select("node", "elements").join(many.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    across = many.join(asked, "node").groupBy("key", "p", "q", "lots").applyInPandas(_link_blocks(percent, boundary), "a long, b long")
    return links.unionByName(checked(last)).unionByName(exact(few)).unionByName(materialize(across.distinct(), "checked-links"))


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, node, n_shingles, root, component_id) of every document.

    Documents of one component share ``root``; without shingles it is null.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        sets = materialize(texts.mapInArrow(_sets(width), SETS), "shingle-sets")
        rows = sets.filter("node IS NOT NULL")
        roots = components(_links(texts.select("text"), sets, width, percent))
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.select("node", "root").join(smallest, "root")
    out = rows.select("doc_id", "text_key", "node", "n").join(named, "node", "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id", "text_key", "node", F.col("n").cast("long").alias("n_shingles"), F.when(~empty, F.col("root")).alias("root"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with the first document (by id, then text) of each component; those without shingles all stay."""
    found = join(docs, width, percent)
    chosen = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("x")).select("x.doc_id", "x.text_key")
    chosen = chosen.toDF("__id", "__key")
    own = [F.col(f"`{c}`") for c in docs.columns]
    has_words = F.coalesce("text", F.lit("")).rlike(WORD)
    rows = docs.filter(has_words).withColumn("__text_key", text_key())
    rows = rows.join(chosen, (F.col("__text_key") == F.col("__key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__text_key"]).select(*own).unionByName(docs.filter(~has_words).select(*own))
