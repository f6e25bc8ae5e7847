"""Product quantisation of vectors by k-means with Drake and Hamerly's adaptive bounds, in integer arithmetic.

Vectors become integers and are cut into parts; each part has a codebook.  A round assigns every part to its nearest
entry and then moves each entry to the floor of the mean of its parts.  Between rounds a row keeps, for every part, its
entry, its ``b`` closest other entries with a lower bound each, in ascending order, and one outer bound for all other
entries.  Entries move; bounds shrink by the moves.  Where a bound is no longer above the exact distance to the own
entry, the case is uncertain: listed entries are compared again in integers, and if the outer bound fails, all
entries are.  ``b`` starts at ``most_bounds`` and shrinks to what 95 of 100 rows of the part needed in the round before.

Rows stay where they are: a round is one pass that reads a written table and writes the next, with the row's bounds
in it; only sums per entry and task are shuffled, and only codebooks reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .components import join_per_key

#: Components up to this magnitude (after scaling) are reckoned in doubles that hold every integer met, larger ones in Python's integers.
SMALL = 1 << 21
#: Part length up to which sums of squares of small components stay exact.
MOST_DIM = 256
#: Bits of a sum that one long carries; larger sums are carried as several.
LIMB = 40


def part_ends(length: int, parts: int) -> list[int]:
    """Where parts begin and end: equal lengths if ``parts`` divides ``length``, else lengths that differ by one."""
    return [length * p // parts for p in range(parts + 1)]


def scaled(v: float, scale: int) -> int:
    """``floor(scale * v)`` of any finite double."""
    return int(v) * scale if abs(v) >= 1 << 53 else math.floor(scale * v)


class Codebook:
    """Entries of one part as Python integers, and which of them a small row need look at.

    ``near``: the small entries.  A small row is never nearest to an entry that is far beyond them; with entries between
    the two, or none small, ``plain`` is false and every case is reckoned in Python's integers.
    """

    def __init__(self, entries: list[list[int]]):
        self.entries = entries
        dim = len(entries[0]) if entries else 0
        big = [max(map(abs, e), default=0) for e in entries]
        far = SMALL + 2 * SMALL * (math.isqrt(dim) + 1)
        self.near = np.array([i for i, b in enumerate(big) if b <= SMALL], np.int64)
        self.plain = len(self.near) > 0 and dim <= MOST_DIM and all(b <= SMALL or b > far for b in big)
        self.values = np.array([entries[i] for i in self.near], np.float64).reshape(len(self.near), dim)
        self.norms = (self.values**2).sum(axis=1)

    def exact(self, x: list[int]) -> tuple[int, int]:
        """Nearest entry and squared distance of a row of any size; ties go to the lower index."""
        d, at = min((sum((v - w) ** 2 for v, w in zip(x, e)), i) for i, e in enumerate(self.entries))
        return at, d

    def drift(self, before: Codebook) -> np.ndarray | None:
        """How far each near entry moved; None where the near entries are others than before."""
        if not (self.plain and before.plain and np.array_equal(self.near, before.near)):
            return None
        return np.sqrt(((self.values - before.values) ** 2).sum(axis=1)) * (1 + 1e-12)


def below(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not above ``x``."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def assign_all(x: np.ndarray, book: Codebook, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the nearest near entries, squared distances, ``b`` closest others and ``b + 1`` bounds, from all distances."""
    # all terms are integers below 2**53, so the products are exact
    d = (x**2).sum(axis=1)[:, None] - 2 * (x @ book.values.T) + book.norms
    own = d.argmin(axis=1)
    rows = np.arange(len(x))
    least = d[rows, own]
    d[rows, own] = np.inf
    k = d.shape[1]
    if k <= b + 1:
        d = np.hstack([d, np.full((len(x), b + 2 - k), np.inf)])
    near = np.argpartition(d, b, axis=1)[:, : b + 1]
    order = np.take_along_axis(d, near, 1).argsort(axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    bounds = below(np.sqrt(np.take_along_axis(d, near, 1)))
    return own, least, np.minimum(near[:, :b], k - 1), bounds


def reassign(
    x: np.ndarray, own: np.ndarray, near: np.ndarray, bounds: np.ndarray, book: Codebook, drift: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same after entries have moved by ``drift``, and how many listed entries each row needed (``b + 1``: all entries)."""
    b = near.shape[1]
    least = ((x - book.values[own]) ** 2).sum(axis=1)
    moved = bounds.astype(np.float64)
    moved[:, :b] -= drift[near]
    moved[:, b] -= drift.max()
    moved = np.minimum.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
    upper = np.sqrt(least) * (1 + 1e-9) + 1e-6
    needed = (moved <= upper[:, None]).sum(axis=1)
    bounds = below(moved)
    some = np.flatnonzero((needed > 0) & (needed <= b))
    if len(some):
        at, rows = near[some], np.arange(len(some))
        asked = np.arange(b) < needed[some][:, None]
        d = ((x[some][:, None, :] - book.values[at]) ** 2).sum(axis=2)
        # the own entry stands beside the listed ones; equal distances go to the lower entry
        every, ids = np.hstack([least[some][:, None], np.where(asked, d, np.inf)]), np.hstack([own[some][:, None], at])
        best = every.min(axis=1)
        won = np.where(every == best[:, None], ids, len(book.near)).min(axis=1)
        place = (ids == won[:, None]).argmax(axis=1)
        lower = np.hstack([np.sqrt(least[some])[:, None], np.where(asked, np.sqrt(d), moved[some][:, :b])])
        lower[rows, place] = np.inf
        order = lower.argsort(axis=1, kind="stable")[:, :b]
        near[some] = np.take_along_axis(ids, order, 1)
        bounds[some, :b] = below(np.take_along_axis(lower, order, 1))
        own[some], least[some] = won, best
    rest = np.flatnonzero(needed > b)
    if len(rest):
        own[rest], least[rest], near[rest], bounds[rest] = assign_all(x[rest], book, b)
    return own, least, near, bounds, needed


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def limbs(value: int, n: int) -> list[int]:
    """``value`` as ``n`` numbers of ``LIMB`` bits, lowest first; the last one carries the sign and whatever is left."""
    out = []
    for _ in range(n - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def next_width(needed: list[int], width: int, least: int) -> int:
    """The smallest list that would have served 95 of 100 rows in the last round; lists never grow."""
    total, seen = sum(needed), 0
    for b, n in enumerate(needed[:width]):
        seen += n
        if total and seen >= 0.95 * total:
            return max(min(least, width), b)
    return width


def train_codes(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    most_bounds: int = 16,
    least_bounds: int = 4,
) -> tuple[DataFrame, list[list[list[int]]]]:
    """``(coded, codebooks)``: all kept rows with ``codes`` (array of int) and ``error`` (decimal digits), and the final entries by part.

    The first ``entries`` rows by ascending ``id_col`` make the first codebooks (equal ids: by vector; rows without an id
    come after all others).  ``rounds`` times every part is assigned to its nearest entry and each entry becomes the floor
    of the mean of its parts; an entry without parts stays.  Then parts are assigned once more.

    Null vectors, vectors with null or non-finite components and vectors of another length than the first
    codebook row's are left out.  An empty vector has parts of length zero, all equal.  Repeated rows each count.  With
    fewer rows than ``entries`` the codebooks are shorter; without rows the result is empty.  Components of any finite
    size are exact.  Other columns are carried along; those named ``codes`` or ``error`` are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    extra = [c for c in rows.columns if c not in (vector_col, "codes", "error")]
    kept = rows.filter(usable(F.col(vector_col))).select(
        F.struct(*extra).alias("row"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")
    )
    first = kept.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    length = len(first[0]["x"]) if first else 0
    ends = part_ends(length, parts)
    books = [[[scaled(v, scale) for v in r["x"][a:b]] for r in first if len(r["x"]) == length] for a, b in zip(ends, ends[1:])]
    widths = [max(1, min(most_bounds, len(b) - 1)) for b in books]
    state = kept.filter(F.size("x") == length).select("row", "x")
    peak = state.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0.0
    n_limbs = 1 if peak * scale < SMALL else (math.frexp(peak)[1] + scale.bit_length() + 64) // LIMB + 1

    fields = "codes array<int>, error string, bounds binary, part int, entry int, n long, needed array<long>, sums array<long>"
    out = StructType([StructField(c, kept.schema[c].dataType) for c in ("row", "x")] + [*StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(out)

    def assigner(now: list[list[list[int]]], past: list[list[list[int]]] | None, listed: list[int], keeps: list[int]):
        """A pass over the rows: stored bounds (``listed`` entries a part) of ``past`` codebooks become bounds of ``now``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened = [Codebook(b) for b in now]
            drifts = [b.drift(Codebook(o)) for b, o in zip(opened, past)] if past else [None] * parts
            counts = [np.zeros(len(b), np.int64) for b in now]
            sums = [np.zeros((len(b), ends[p + 1] - ends[p])) for p, b in enumerate(now)]
            large: list[dict[int, list[int]]] = [{} for _ in now]
            asked = np.zeros((parts, most_bounds + 2), np.int64)
            for batch in batches:
                n, column = batch.num_rows, batch.column(1)
                if not n:
                    continue
                raw = column.flatten().to_numpy(zero_copy_only=False).reshape(n, length)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * raw)
                stored = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1) if past else None
                codes, errors, beyond, packed, at = np.empty((n, parts), np.int32), np.zeros(n, np.int64), {}, [], 0
                for p, book in enumerate(opened):
                    xp, b, k = x[:, ends[p] : ends[p + 1]], listed[p], keeps[p]
                    own, near, bounds = np.zeros(n, np.int64), np.zeros((n, b), np.int64), np.full((n, b + 1), -np.inf, np.float32)
                    if past:
                        mine = np.ascontiguousarray(stored[:, at : at + 6 * (b + 1)])
                        at += 6 * (b + 1)
                        ids = mine[:, : 2 * (b + 1)].copy().view(np.uint16).astype(np.int64)
                        own, near, bounds = ids[:, 0], ids[:, 1:], mine[:, 2 * (b + 1) :].copy().view(np.float32)
                    plain = np.flatnonzero((np.abs(xp) <= SMALL).all(axis=1)) if book.plain else np.empty(0, np.int64)
                    if len(plain):
                        xs = xp[plain]
                        if drifts[p] is None:
                            o, d, near[plain], bounds[plain] = assign_all(xs, book, b)
                        else:
                            o, d, near[plain], bounds[plain], need = reassign(xs, own[plain], near[plain], bounds[plain], book, drifts[p])
                            asked[p] += np.bincount(np.where(need > b, most_bounds + 1, need), minlength=most_bounds + 2)
                        own[plain], codes[plain, p] = o, book.near[o]
                        errors[plain] += d.astype(np.int64)
                        counts[p] += np.bincount(book.near[o], minlength=len(counts[p]))
                        for j in range(xs.shape[1]):
                            sums[p][:, j] += np.bincount(book.near[o], weights=xs[:, j], minlength=len(counts[p]))
                    for i in np.setdiff1d(np.arange(n), plain).tolist():
                        exact = [scaled(v, scale) for v in raw[i, ends[p] : ends[p + 1]].tolist()]
                        e, d = book.exact(exact)
                        # bounds of minus infinity: the next round asks all entries
                        codes[i, p], bounds[i], beyond[i] = e, -np.inf, beyond.get(i, 0) + d
                        counts[p][e] += 1
                        large[p][e] = [v + w for v, w in zip(large[p].get(e, [0] * len(exact)), exact)]
                    # of a list cut short the first entry that falls out becomes the outer bound
                    cut = np.hstack([bounds[:, :k], bounds[:, k:].min(axis=1, keepdims=True)])
                    ids = np.hstack([own[:, None], near[:, :k]]).astype(np.uint16)
                    packed += [ids.view(np.uint8).reshape(n, -1), np.ascontiguousarray(cut).view(np.uint8).reshape(n, -1)]
                whole = np.ascontiguousarray(np.hstack(packed))
                offsets = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(whole.shape[1]))
                digits = [str(v + beyond.get(i, 0)) for i, v in enumerate(errors.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(arrow.field("row").type),
                        column.cast(arrow.field("x").type),
                        pa.array(list(codes), type=arrow.field("codes").type),
                        pa.array(digits, type=arrow.field("error").type),
                        pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(whole)]).cast(arrow.field("bounds").type),
                        *[pa.nulls(n, f.type) for f in list(arrow)[5:]],
                    ],
                    schema=arrow,
                )
            total = []
            for p in range(parts):
                total.append((p, None, None, asked[p].tolist(), None))
                for e in np.flatnonzero(counts[p]).tolist():
                    own_sum = [int(v) + w for v, w in zip(sums[p][e], large[p].get(e) or [0] * sums[p].shape[1])]
                    total.append((p, e, int(counts[p][e]), None, [w for v in own_sum for w in limbs(v, n_limbs)]))
            nulls = [pa.nulls(len(total), f.type) for f in list(arrow)[:5]]
            yield pa.RecordBatch.from_arrays(nulls + [pa.array([t[i] for t in total], type=arrow.field(5 + i).type) for i in range(5)], schema=arrow)

        return run

    past, listed, before = None, widths, None
    for turn in range(rounds + 1):
        after = materialize(state.mapInArrow(assigner(books, past, listed, widths), out), "codes")
        discard(before)
        before, listed = after, widths
        state = after.filter(F.col("x").isNotNull()).select("row", "x", "bounds")
        if turn < rounds:
            past, (books, widths) = books, _moved(after, books, widths, n_limbs, most_bounds, least_bounds)
    return after.filter(F.col("x").isNotNull()).select("row.*", "codes", "error"), books


def _moved(
    after: DataFrame, books: list[list[list[int]]], widths: list[int], n_limbs: int, most_bounds: int, least_bounds: int
) -> tuple[list[list[list[int]]], list[int]]:
    """Entries at the means of their parts, and how many entries each part's rows list from now on."""
    sums = after.filter(F.col("part").isNotNull())
    wide = max((len(b[0]) for b in books if b), default=0) * n_limbs
    total = lambda name, n: F.array(*[F.sum(F.get(name, F.lit(j))) for j in range(n)]).alias(name)
    moved, kept = [list(b) for b in books], list(widths)
    for r in sums.filter(F.col("entry").isNotNull()).groupBy("part", "entry").agg(F.sum("n").alias("n"), total("sums", wide)).collect():
        whole = [sum(v << (LIMB * i) for i, v in enumerate(r["sums"][j : j + n_limbs])) for j in range(0, len(books[r["part"]][0]) * n_limbs, n_limbs)]
        moved[r["part"]][r["entry"]] = [v // r["n"] for v in whole]
    for r in sums.filter(F.col("entry").isNull()).groupBy("part").agg(total("needed", most_bounds + 2)).collect():
        kept[r["part"]] = next_width(r["needed"], widths[r["part"]], least_bounds)
    return moved, kept


def codebook_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error and the digest of the codebooks, for every usable vector.

    An error that no long can hold is null.
    """
    coded, books = train_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digit = lambda v: F.lower(F.lpad(F.hex(v.cast("long")), 2, "0"))
    rows = coded.select(
        "vec_id",
        F.array_join(F.transform("codes", digit), "").alias("code"),
        F.expr("try_cast(error as bigint)").alias("error"),
        F.expr("try_cast(error as decimal(38, 0))").alias("__error"),
        F.when(F.col("label").isNull(), "none").otherwise(F.concat(F.lit("label "), F.col("label").cast("string"))).alias("__label"),
    )
    per = rows.groupBy("__label").agg(F.expr("try_cast(sum(__error) as bigint)").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_per_key(rows, per, "__label").select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same for DuckDB, with every distance reckoned in every round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""cut AS MATERIALIZED (
  SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v
  FROM kept, (SELECT unnest(range({parts})) AS part)
)""",
        f"""book0 AS MATERIALIZED (
  SELECT part, idx, v FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM kept) USING (vec_id)
  WHERE idx < {entries}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(label) AS label, any_value(v) AS v, min(d) AS d, arg_min(idx, (d, idx)) AS idx
  FROM (SELECT c.*, b.idx, list_sum(list_transform(list_zip(c.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM cut c JOIN book{r} b ON c.part = b.part)
  GROUP BY vec_id, part
)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.idx, coalesce(m.v, b.v) AS v
  FROM book{r} b LEFT JOIN (
    SELECT part, idx, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v
    FROM (SELECT part, idx, pos, sum(x) AS s, count(*) AS n
          FROM (SELECT part, idx, unnest(v) AS x, unnest(range(len(v))) AS pos FROM near{r}) GROUP BY part, idx, pos)
    GROUP BY part, idx
  ) m ON b.part = m.part AND b.idx = m.idx
)""")
    return f"""WITH {", ".join(steps)}, digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, idx, pos)) AS h
  FROM (SELECT part, idx, unnest(v) AS x, unnest(range(len(v))) AS pos FROM book{rounds})
), coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', idx), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded, digest"""


OP11_SQL = codes_sql()
