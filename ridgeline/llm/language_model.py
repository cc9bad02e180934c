"""LM scoring by a hierarchical Pitman-Yor model.

Symbols are the ``DISHES`` most frequent training words, the end of a text, and one
class for all other words.  Every context (the previous symbol: the most frequent ones
one by one, the start, and all others together) is a restaurant whose dishes are
symbols; the customers that open a table there are served by the parent restaurant,
which all contexts share and whose base is uniform.  Words of the class are told apart
by a Pitman-Yor restaurant of their own, with a uniform base over its words and one
unknown word.  So the probabilities of all words after a context, the unknown word
included, sum to one.

Counts are taken by Spark over all training documents.  Gibbs sweeps reseat, in turn,
the customers of every context given the parent's probabilities (on the executors, a
row per context) and those of the parent; a dish's first ``ONE_BY_ONE`` customers are
seated one by one, further ones in blocks that grow by an eighth, with the chance of a
new table held within a block.  Predictive probabilities are averaged over the sweeps
after ``BURN_IN``.  A word's table count in the class's restaurant depends on its count
only, so its seating is sampled as curves over counts.

These shared restaurants are the parents of the words' own: every training word (and the
start) is a context with a restaurant of its own, whose dishes are all words and the end, and
whose base is what the shared model says of the word there.  They are rows, one per distinct
pair of neighbours, dealt by context; nothing is lumped at this level and it grows with the
corpus.  Given the parent a word follows with ``A + B * parent``, so a text's score is the
parent's, plus log B of every context, plus log(1 + A / (B * parent)) of every pair that
training has seen.

The model that goes to the tasks has a fixed size (contexts x symbols) besides the
counts of the ``KNOWN`` most frequent words and the gains of the ``PAIRS`` most frequent
pairs.  Rarer tokens and pairs of a text are joined to the tables of all words and pairs, so the
whole vocabulary and all pairs take part however many they are.

Null texts are empty: one token, the end.  Repeated rows and null ids are scored row by
row; a null id belongs to the training part.  Without training texts all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import claim, forget_words, hash_of, learns, materialize, texts_of, word_hashes

DISHES, CONTEXTS, KNOWN = 16_382, 256, 150_000
SWEEPS, BURN_IN, ONE_BY_ONE = 6, 2, 24
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
CHUNK_TOKENS = 1_000_000
PAIRS, SEATED_ROWS = 1_000_000, 400_000
START, END = -0x61C8864680B583EB, 0x2545F4914F6CDD1D  # stand for the start and the end among the word hashes


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, c, docs): counts of word hashes; one row with the documents of the batch."""
    import numpy as np

    def counted(held):
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c)], names=["w", "c"])

    claim("words", forget_words)
    held, size = [], 0
    for batch in batches:
        for text in texts_of(batch.column(0)):
            held.append(word_hashes(text))
            size += len(held[-1])
            if size >= 2 * CHUNK_TOKENS:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


class Ranks(dict):
    """Frequency rank of a word among the known ones, else -1; bounded."""

    def __init__(self, hashes):
        super().__init__()
        self.of = {int(h): i for i, h in enumerate(hashes)}

    def __missing__(self, word: bytes) -> int:
        value = self.of.get(hash_of(word), -1)
        if len(self) >= 150_000:
            self.clear()
        self[word] = value
        return value


def _seats(customers, rate, discount: float, rng):
    """Tables of each dish after seating its customers; rate: weight of a new table there."""
    import numpy as np

    tables = np.minimum(customers, 1).astype(np.float64)
    at, seated = np.flatnonzero(customers > 1), 1
    while len(at):
        block = 1 if seated < ONE_BY_ONE else seated // 8
        n = np.minimum(block, customers[at] - seated).astype(np.int64)
        old = np.maximum(seated - discount * tables[at], 1e-9)
        tables[at] += rng.binomial(n, rate[at] / (rate[at] + old))
        seated += block
        at = at[customers[at] > seated]
    return tables


def _discount(counts) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(0.95, max(0.1, (once + 1) / (once + 2 * twice + 2)))


class Model:
    """log10 probabilities: ``table[context, symbol]``, and of words within the class by count."""

    def __init__(self, table, context_of, grid, tail, hashes, counts, total, distinct, discount=0.5):
        self.discount = discount
        self.table, self.context_of, self.grid, self.tail = table, context_of, grid, tail
        self.hashes, self.counts, self.total, self.distinct = hashes, counts, total, distinct

    def class_log(self, c):
        """log10 P(word | class) of words of count c."""
        import numpy as np

        discount, n, new, share, curve = self.tail
        c = np.asarray(c, float)
        t = np.interp(np.log(np.maximum(c, 1)), self.grid, curve)
        return np.log10(np.maximum(np.where(c > 0, c - discount * t, 0), 0) / n + new * share)

    def base_log(self, c):
        import numpy as np

        return np.log10((np.asarray(c, float) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _class_restaurant(bins, strength: float = 1.0):
    """(grid of log counts, (discount, customers + strength, weight of a new table, base share, tables by count))."""
    import numpy as np

    c = np.array([r["mean"] for r in bins]) if bins else np.zeros(0)
    n = np.array([r["n"] for r in bins], float) if bins else np.zeros(0)
    types, customers = n.sum(), (c * n).sum()
    once, twice = n[c < 1.5].sum(), n[(c >= 1.5) & (c < 2.5)].sum()
    discount = min(0.95, max(0.1, (once + 1) / (once + 2 * twice + 2)))
    share = 1 / (types + 1)
    counts = np.unique(np.concatenate([np.arange(1, 65), np.geomspace(64, max(65.0, c.max(initial=1) * 1.01), 200)]))
    rng, curves, tables = np.random.default_rng(17), [], types
    for sweep in range(SWEEPS):
        rate, seated, t = (strength + discount * tables) * share, 1.0, np.ones(512)
        curve = [1.0]
        for after in counts[1:]:
            block = after - seated
            p = rate / (rate + np.maximum(seated - discount * t, 1e-9))
            t = t + (rng.random(512) < p if block == 1 else rng.poisson(block * p))
            seated = after
            curve.append(float(np.minimum(t, seated).mean()))
        tables = float((np.interp(np.log(np.maximum(c, 1)), np.log(counts), curve) * n).sum())
        if sweep >= BURN_IN:
            curves.append(curve)
    curve = np.mean(curves, axis=0)
    tables = float((np.interp(np.log(np.maximum(c, 1)), np.log(counts), curve) * n).sum())
    total = customers + strength
    return np.log(counts), (discount, total, (strength + discount * tables) / total, share, curve)


def _bigram_counts(hashes, context_of, dishes: int):
    """cell = context * (dishes + 2) + symbol, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        claim("words", forget_words)
        ranks, width, total, held, size = Ranks(hashes.value[:dishes]), dishes + 2, None, [], 0

        def add(total, held):
            n = np.bincount(np.concatenate(held), minlength=CONTEXTS * width).astype(np.int32)
            return n if total is None else total + n

        for batch in batches:
            for text in texts_of(batch.column(0)):
                _, symbols = _symbols(text, ranks, dishes)
                held.append(context_of[np.concatenate([[dishes + 2], symbols[:-1]])] * width + symbols)
                size += len(symbols)
                if size >= CHUNK_TOKENS:
                    total, held, size = add(total, held), [], 0
        if held:
            total = add(total, held)
        if total is not None:
            cells = np.flatnonzero(total)
            for a in range(0, len(cells), 200_000):
                part = cells[a : a + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["cell", "c"])

    return run


def _symbols(text: bytes | None, ranks: Ranks, dishes: int):
    """(ranks of the words, symbols with the end): class dishes, end dishes + 1; dishes + 2 is the start as a context."""
    import numpy as np

    words = text.lower().split() if text else []
    rank = np.fromiter(map(ranks.__getitem__, words), np.int64, len(words))
    return rank, np.append(np.where((rank >= 0) & (rank < dishes), rank, dishes), dishes + 1)


RESTAURANT = "context int, dishes binary, customers binary"


def _restaurants(cells: DataFrame, width: int) -> DataFrame:
    """One row per context with the arrays of its dishes and their customers (at most width each)."""

    def pack(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("dish")
        return pd.DataFrame({"context": [key[0]], "dishes": [pdf["dish"].to_numpy().astype("<i4").tobytes()], "customers": [pdf["c"].to_numpy().astype("<i8").tobytes()]})

    rows = cells.select((F.col("cell") / width).cast("int").alias("context"), (F.col("cell") % width).cast("int").alias("dish"), "c")
    return rows.groupBy("context").applyInPandas(pack, RESTAURANT)


def _sweep(parent, tables_before, discount: float, seed: int):
    """Reseat each context given the parent: (context, tables of its dishes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for context, dishes, customers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                dish, c = np.frombuffer(dishes, "<i4"), np.frombuffer(customers, "<i8")
                rng = np.random.default_rng([seed, context])
                open_rate = STRENGTH + discount * tables_before.get(context, len(dish))
                t = _seats(c, open_rate * parent[dish], discount, rng)
                yield pa.RecordBatch.from_arrays([pa.array([context], pa.int32()), pa.array([t.astype("<f4").tobytes()])], names=["context", "tables"])

    return run


def train(texts: DataFrame, dishes: int = DISHES, known: int = KNOWN) -> tuple[Model, DataFrame]:
    """(model, counts of all words) from the rows of ``text`` (binary)."""
    import numpy as np

    spark = texts.sparkSession
    n_docs = texts.count()
    counts = materialize(texts.mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "lm-counts")
    words, tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = counts.orderBy(F.col("c").desc(), "w").limit(known).toArrow()
    hashes, top_counts = top.column("w").to_numpy(), top.column("c").to_numpy()
    dishes = min(dishes, max(len(hashes), 1))
    width = dishes + 2
    # contexts: the first CONTEXTS - 2 symbols one by one, the start, all others
    context_of = np.full(width + 1, CONTEXTS - 1, np.int64)
    own = min(dishes, CONTEXTS - 2)
    context_of[:own], context_of[dishes + 2] = np.arange(own), CONTEXTS - 2
    rare = counts
    if len(hashes) >= dishes:
        c, w = int(top_counts[dishes - 1]), int(hashes[dishes - 1])
        rare = counts.filter((F.col("c") < c) | ((F.col("c") == c) & (F.col("w") > w)))
    bins = rare.groupBy(F.floor(F.log(F.col("c")) * 16).alias("b")).agg(F.avg("c").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    grid, tail = _class_restaurant(bins)

    shared = spark.sparkContext.broadcast(hashes)
    cells = texts.mapInArrow(_bigram_counts(shared, context_of, dishes), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    cells = materialize(cells, "lm-bigrams")
    low = {r["c"]: r["n"] for r in cells.filter("c <= 2").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    discount = min(0.95, max(0.1, (low.get(1, 0) + 1) / (low.get(1, 0) + 2 * low.get(2, 0) + 2)))
    rows = materialize(_restaurants(cells, width), "lm-restaurants")

    seats = {r["context"]: (np.frombuffer(r["dishes"], "<i4"), np.frombuffer(r["customers"], "<i8")) for r in rows.collect()}
    rng = np.random.default_rng(29)
    parent, tables, table, samples = np.full(width, 1 / width), {}, np.zeros((CONTEXTS, width), np.float32), 0
    for sweep in range(SWEEPS):
        seated = rows.mapInArrow(_sweep(parent, tables, discount, sweep), "context int, tables binary").collect()
        seated = {r["context"]: np.frombuffer(r["tables"], "<f4") for r in seated}
        if sweep >= BURN_IN:
            samples += 1
            for context in range(CONTEXTS):
                dish, c = seats.get(context, (np.zeros(0, np.int32), np.zeros(0)))
                t = seated.get(context, np.zeros(0))
                total = STRENGTH + c.sum()
                table[context] += (STRENGTH + discount * t.sum(dtype=np.float64)) / total * parent
                table[context, dish] += (c - discount * t) / total
        served = np.zeros(width)
        for context, t in seated.items():
            served[seats[context][0]] += t
            tables[context] = float(t.sum(dtype=np.float64))
        d0 = _discount(served)
        upper = np.minimum(served, 1)
        upper = _seats(served, np.full(width, (PARENT_STRENGTH + d0 * upper.sum()) / width), d0, rng)
        total = PARENT_STRENGTH + served.sum()
        parent = (served - d0 * upper) / total + (PARENT_STRENGTH + d0 * upper.sum()) / total / width
    table = np.log10(table / np.float32(samples))
    end = 1 if n_docs else 0
    model = Model(table, context_of, grid, tail, hashes, np.append(top_counts, n_docs), int(tokens) + n_docs, int(words) + end, discount)
    return model, counts


def _pair_key(c, w):
    """64-bit key of a context and the word after it (wraps around)."""
    import numpy as np

    return c * np.int64(-0x61C8864680B583EB) + w


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, w, n): neighbours of training texts, the start and the end among them."""
    import numpy as np

    claim("words", forget_words)

    def counted(held):
        c, w = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        _, first, n = np.unique(_pair_key(c, w), return_index=True, return_counts=True)
        for a in range(0, len(n), 200_000):
            at = first[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(w[at]), pa.array(n[a : a + 200_000])], names=["c", "w", "n"])

    held, size = [], 0
    for batch in batches:
        for text in texts_of(batch.column(0)):
            words = word_hashes(text)
            held.append((np.append(np.int64(START), words), np.append(words, np.int64(END))))
            size += len(words) + 1
            if size >= 2 * CHUNK_TOKENS:
                yield from counted(held)
                held, size = [], 0
    if held:
        yield from counted(held)


def _uniform(key, step: int):
    """Numbers in (0, 1) by key and step: seats do not depend on how the rows are dealt."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64((step * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def _new_tables(n, p, key, step: int):
    """Binomial(n, p) by the key's own numbers; a normal number for large means."""
    import numpy as np

    u, mean = _uniform(key, 2 * step), n * p
    out = np.zeros(len(n))
    wide = np.flatnonzero(mean > 25)
    if len(wide):
        z = np.sqrt(-2 * np.log(u[wide])) * np.cos(2 * np.pi * _uniform(key[wide], 2 * step + 1))
        out[wide] = np.clip(np.rint(mean[wide] + z * np.sqrt(mean[wide] * (1 - p[wide]))), 0, n[wide])
    at, k = np.flatnonzero(mean <= 25), 0
    q = np.minimum(p[at], 1 - 1e-12)
    term = np.exp(n[at] * np.log1p(-q))
    below, odds = term.copy(), q / (1 - q)
    while len(at):
        more = (u[at] > below) & (k < n[at])
        at, term, below, odds = at[more], term[more], below[more], odds[more]
        term = term * (n[at] - k) / (k + 1) * odds
        below, k = below + term, k + 1
        out[at] = k
    return out


def _own_seats(customers, rate, discount: float, key, sweep: int):
    """Tables of each dish as in ``_seats``, drawn by the key of the pair."""
    import numpy as np

    tables = np.minimum(customers, 1).astype(np.float64)
    at, seated, step = np.flatnonzero(customers > 1), 1, 0
    while len(at):
        block = 1 if seated < ONE_BY_ONE else seated // 8
        n = np.minimum(block, customers[at] - seated)
        p = rate[at] / (rate[at] + np.maximum(seated - discount * tables[at], 1e-9))
        tables[at] += _new_tables(n, p, key[at], sweep * 1000 + step)
        seated, step = seated + block, step + 1
        at = at[customers[at] > seated]
    return tables


OWN = "k long, c long, w long, n long, ratio double, back double"


def _own_restaurants(shared, dishes: int):
    """Rows (c, w, n), sorted by context, to OWN: A / (B * parent) of the pair, and log10 B of the context.

    ``w`` stays only where the word is not among the known ones: there ``ratio`` still lacks the
    word's share of the class (and its seating goes by its count in this context).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        claim("words", forget_words)
        model = shared.value
        order = np.argsort(model.hashes)
        ordered, known = model.hashes[order], len(model.hashes)

        def rank_of(h):
            if not known:
                return np.full(len(h), -1)
            at = np.minimum(np.searchsorted(ordered, h), known - 1)
            return np.where(ordered[at] == h, order[at], -1)

        def seated(c, w, n):
            new = np.append(True, c[1:] != c[:-1])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            before, rank = rank_of(c[first]), rank_of(w)
            before = np.where((before >= 0) & (before < dishes), before, dishes)
            before[c[first] == START] = dishes + 2
            context = model.context_of[before][group]
            symbol = np.where((rank >= 0) & (rank < dishes), rank, np.where(w == END, dishes + 1, dishes))
            parent = 10.0 ** model.table[context, symbol].astype(np.float64)
            inside = symbol == dishes
            parent[inside & (rank >= 0)] *= 10.0 ** model.class_log(model.counts[rank[inside & (rank >= 0)]])
            rare = inside & (rank < 0)
            guess = parent.copy()
            guess[rare] *= 10.0 ** model.class_log(n[rare])
            total = np.bincount(group, n) + STRENGTH
            key, tables, mean = _pair_key(c, w), np.bincount(group).astype(np.float64), np.zeros(len(n))
            for sweep in range(SWEEPS):
                t = _own_seats(n, (STRENGTH + model.discount * tables[group]) * guess, model.discount, key, sweep)
                tables = np.bincount(group, t)
                if sweep >= BURN_IN:
                    mean += t / (SWEEPS - BURN_IN)
            back = (STRENGTH + model.discount * np.bincount(group, mean)) / total
            ratio = (n - model.discount * mean) / total[group] / (back[group] * parent)
            out = [pa.array(key), pa.array(c), pa.array(w, mask=~rare), pa.array(n), pa.array(ratio), pa.array(np.log10(back)[group])]
            for a in range(0, len(c), 50_000):
                yield pa.RecordBatch.from_arrays([x.slice(a, 50_000) for x in out], names=["k", "c", "w", "n", "ratio", "back"])

        held, size = [], 0
        for batch in batches:
            held.append([x.to_numpy() for x in batch.columns])
            size += batch.num_rows
            if size >= SEATED_ROWS:
                c, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.searchsorted(c, c[-1]))  # the last context may go on
                if whole:
                    yield from seated(c[:whole], w[:whole], n[:whole])
                held, size = [[c[whole:], w[whole:], n[whole:]]], len(c) - whole if whole else 0
        if held:
            c, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(c):
                yield from seated(c, w, n)

    return run


def own_restaurants(texts: DataFrame, shared, dishes: int) -> DataFrame:
    """OWN of every pair of neighbours in the training texts, see ``_own_restaurants``."""
    # dealt by context before they are added up, so that counting and seating share one shuffle
    pairs = texts.mapInArrow(_pair_counts, "c long, w long, n long").repartition("c").groupBy("c", "w").agg(F.sum("n").alias("n"))
    return materialize(pairs.sortWithinPartitions("c", "w").mapInArrow(_own_restaurants(shared, dishes), OWN), "lm-own")


PARTS = "row long, doc_id long, n_tokens long, n_known long, base double, score double, n_rare long, w long, k long"


def _scores(shared, dishes: int, own):
    """A row per document, one per rare token (w) to be joined to the counts, and one per rare pair (k) to be joined to the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        claim("words", forget_words)
        model = shared.value
        ranks, known = Ranks(model.hashes), len(model.hashes)
        base = model.base_log(model.counts)
        within = np.append(np.where(np.arange(known) < dishes, 0, model.class_log(model.counts[:known])), 0)
        backs, start, keys, gains = own.value
        row = TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            docs, rare_rows, rare_words, pair_rows, pair_keys = [], [], [], [], []
            for doc_id, text in zip(texts_of(batch.column(0)), texts_of(batch.column(1)), strict=True):
                row += 1
                rank, symbols = _symbols(text, ranks, dishes)
                context = model.context_of[np.concatenate([[dishes + 2], symbols[:-1]])]
                seen = rank[rank >= 0]
                rest = np.flatnonzero(rank < 0)
                score = model.table[context, symbols].sum(dtype=np.float64) + within[seen].sum()
                words = word_hashes(text)
                pairs = _pair_key(np.append(np.int64(START), words), np.append(words, np.int64(END)))
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                common = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                score += backs[seen].sum() + start + gains[at[common]].sum(dtype=np.float64)
                pair_rows.append(np.full(len(pairs) - int(common.sum()), row))
                pair_keys.append(pairs[~common])
                end_known = int(model.counts[-1] > 0)
                docs.append((row, doc_id, len(symbols), len(seen) + end_known, base[seen].sum() + base[-1], score, len(rest), None, None))
                if len(rest):
                    rare_rows.append(np.full(len(rest), row))
                    rare_words.append(words[rest])
            kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.int64()] * 3
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs, strict=True), kinds, strict=True)], names=names)
            for column, at_rows, found in ((7, rare_rows, rare_words), (8, pair_rows, pair_keys)):
                if not at_rows:
                    continue
                r, x = np.concatenate(at_rows), np.concatenate(found)
                for a in range(0, len(r), 200_000):
                    cells = [pa.nulls(len(r[a : a + 200_000]), t) for t in kinds]
                    cells[0], cells[column] = pa.array(r[a : a + 200_000]), pa.array(x[a : a + 200_000])
                    yield pa.RecordBatch.from_arrays(cells, names=names)

    return run


def _gains(own: DataFrame, rest: DataFrame, model: Model) -> DataFrame:
    """(k, n, gain): log10(1 + A / (B * parent)) of every pair; words that are not known get their share of the class here."""
    small = Model(None, None, model.grid, model.tail, None, None, model.total, model.distinct)

    def shared_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            gain = np.log10(1 + batch.column(2).to_numpy() / 10.0 ** small.class_log(batch.column(3).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gain)], names=["k", "n", "gain"])

    rare = own.filter("w IS NOT NULL").select("w", "k", "n", "ratio").join(rest.select("w", "c"), "w").select("k", "n", "ratio", "c")
    rare = materialize(rare.mapInArrow(shared_out, "k long, n long, gain double"), "lm-rare-gains")
    return own.filter("w IS NULL").select("k", "n", F.log10(1 + F.col("ratio")).alias("gain")).unionByName(rare)


def _common(contexts: DataFrame, gains: DataFrame, model: Model):
    """Broadcast: log10 B of the known words, of the start, and the gains of the most frequent pairs, by key."""
    import numpy as np

    spark = contexts.sparkSession
    order = np.argsort(model.hashes)
    backs, start = np.zeros(len(order)), 0.0
    known = spark.createDataFrame(pa.table({"w": pa.array(np.append(model.hashes, np.int64(START)), pa.int64())}))
    found = contexts.join(known, "w").toArrow()
    w, back = found.column("w").to_numpy(), found.column("back").to_numpy()
    if (w == START).any():
        start = float(back[w == START][0])
        w, back = w[w != START], back[w != START]
    backs[order[np.searchsorted(model.hashes[order], w)]] = back
    most, pairs = None, 0
    for r in gains.groupBy("n").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.col("n").desc()).limit(PAIRS).toLocalIterator():
        pairs += r["pairs"]
        if pairs > PAIRS:
            break
        most = r["n"]
    top = gains.filter(F.col("n") >= most if most is not None else F.lit(False)).select("k", "gain").toArrow()
    k, gain = top.column("k").to_numpy(), top.column("gain").to_numpy()
    at = np.argsort(k)
    return spark.sparkContext.broadcast((backs, start, k[at], gain[at].astype(np.float32)))


def scored(docs: DataFrame, fold: int = 1, dishes: int = DISHES, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    import numpy as np

    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    learned = texts.filter(learns("doc_id", fold)).select("text")
    model, counts = train(learned, dishes, known)
    dishes = len(model.context_of) - 3
    shared = spark.sparkContext.broadcast(model)
    own = own_restaurants(learned, shared, dishes)
    contexts = materialize(own.groupBy(F.col("c").alias("w")).agg(F.first("back").alias("back")), "lm-contexts")
    if len(model.hashes):
        rest = counts.filter(F.col("c") <= int(model.counts[len(model.hashes) - 1]))  # the only ones that rare tokens can be
    else:
        rest = counts
    gains = _gains(own, rest, model)
    parts = materialize(texts.mapInArrow(_scores(shared, dishes, _common(contexts, gains, model)), PARTS), "lm-parts")
    rare = parts.filter("w IS NOT NULL").select("row", "w")

    # the class's probabilities by count: few distinct counts, a row per word
    grid, tail, total, distinct = model.grid, model.tail, model.total, model.distinct
    small = Model(None, None, grid, tail, None, None, total, distinct)

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small.base_log(c)), pa.array(small.class_log(c))], names=["w", "base", "score"])

    of_words = rest.mapInArrow(logs, "w long, base double, score double").join(contexts, "w", "left")
    of_words = of_words.select("w", "base", (F.col("score") + F.coalesce("back", F.lit(0.0))).alias("score"))
    unknown_base, unknown = float(small.base_log(np.zeros(1))[0]), float(small.class_log(np.zeros(1))[0])
    joined = rare.join(of_words, "w", "left").groupBy("row").agg(
        F.count("base").alias("k"), F.sum(F.coalesce("base", F.lit(unknown_base))).alias("b"), F.sum(F.coalesce("score", F.lit(unknown))).alias("s")
    )
    zero = F.lit(0)
    paired = parts.filter("k IS NOT NULL").select("row", "k").join(gains.select("k", "gain"), "k").groupBy("row").agg(F.sum("gain").alias("g"))
    done = parts.filter("w IS NULL AND k IS NULL").drop("w", "k").join(joined, "row", "left").join(paired, "row", "left")
    return done.select(
        "doc_id", (~learns("doc_id", fold)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", zero)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero) + F.coalesce("g", zero)).alias("score"),
    )
